"""Small tables with the hard cases: nulls, empty and long texts, ties, repeats, extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    r = random.Random(seed)
    words = [a + b for a in ("ka", "lo", "mi", "ter", "sun", "ol") for b in ("ra", "ne", "tik", "om", "du")]
    line = lambda k: " ".join(r.choice(words) for _ in range(k))
    common = line(12)
    texts = []
    for i in range(n):
        lines = [line(r.randint(1, 25)) for _ in range(r.randint(1, 8))]
        if i % 5 == 0:
            lines.insert(0, common)
        if i % 7 == 0:
            w = common.split()
            w[r.randrange(len(w))] = "changed"
            lines.append(" ".join(w))
        texts.append("\n".join(lines))
    texts += [texts[3], texts[3], texts[4] + " end", None, "", "   \n\t\n", "one", "é ü 😀", line(5000)]
    for i in (10, 11):
        w = texts[i].split(" ")
        w[len(w) // 2] = "other"
        texts.append(" ".join(w))
    return [(i * 3, t, "en" if i % 2 else "de", None if i % 11 == 0 else f"s{i % 4}", len(t) if t is not None else None) for i, t in enumerate(texts)]
