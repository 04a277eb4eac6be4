"""Queries on names and texts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import names, notation
from graphloom.operators import labels
from graphloom.plans.collect import collector
from graphloom.plans.stash import stash
from graphloom.sources import star
from graphloom.sources.star import FUNC

QUERIES, SQL, query = collector()


def _list(words) -> str:
    return "(" + ", ".join("'" + w + "'" for w in words) + ")"


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CANON = f"regexp_replace({_LOW.format('raw')}, '{names.LEADING}', '')"
_RAW = """raw AS (
  SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN '__imp__' || m WHEN 1 THEN 'j_' || m || '@@4' WHEN 2 THEN m || '_' || p_partkey
    WHEN 3 THEN '_' || upper(m) || '@8' WHEN 4 THEN p_name ELSE '?' || m || '@x' END AS raw
  FROM (SELECT *, ['malloc', 'main', 'memcpy', 'render', 'pthread_create', 'std::sort', 'threadproc', 'draw'][1 + p_partkey % 8] AS m FROM part))"""


def _raw(spark, sf_dir):
    """Decorated names: a runtime or own name in one of the forms that linkers make."""
    k = F.col("p_partkey")
    m = F.element_at(F.array(*[F.lit(x) for x in ("malloc", "main", "memcpy", "render", "pthread_create", "std::sort", "threadproc", "draw")]), (1 + k % 8).cast("int"))
    form = k % 6
    raw = (
        F.when(form == 0, F.concat(F.lit("__imp__"), m)).when(form == 1, F.concat(F.lit("j_"), m, F.lit("@@4"))).when(form == 2, F.concat_ws("_", m, k))
        .when(form == 3, F.concat(F.lit("_"), F.upper(m), F.lit("@8"))).when(form == 4, F.col("p_name")).otherwise(F.concat(F.lit("?"), m, F.lit("@x")))
    )
    return star.table(spark, sf_dir, "part").select(k.alias("id"), raw.alias("raw"))


@query(f"""
WITH {_RAW}, c AS (
  SELECT id, raw, {_CANON} AS s FROM raw),
d AS (SELECT *, regexp_replace(CASE WHEN contains(s, '@@') THEN regexp_replace(s, '@@.*$', '') WHEN s LIKE '?%' THEN s ELSE regexp_replace(s, '@.*$', '') END, '(?:_[0-9]+)+$', '') AS canonical FROM c)
SELECT id, canonical, canonical IN {_list(names.RUNTIME_NAMES)} OR {' OR '.join(f"starts_with(canonical, '{p}')" for p in names.RUNTIME_PREFIXES)} AS is_runtime,
       CASE WHEN s LIKE '?%' THEN s ELSE regexp_replace(s, '@.*$', '') END IN {_list(names.ENTRY_NAMES)} AS is_entry
FROM d
""")
def runtime_name(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    named = raw.select("id", names.canonical_runtime_name(F.col("raw")).alias("canonical"), names.is_entry_like(F.col("raw")).alias("is_entry"))
    return named.select("id", "canonical", names.is_runtime_canonical(F.col("canonical")).alias("is_runtime"), "is_entry")


@query(f"""
WITH {_RAW}, s AS (
  SELECT id, regexp_replace(CASE WHEN contains(c, '@@') THEN regexp_replace(c, '@@.*$', '') WHEN c LIKE '?%' THEN c ELSE regexp_replace(c, '@.*$', '') END, '(?:_[0-9]+)+$', '') AS n
  FROM (SELECT id, {_CANON} AS c FROM raw))
SELECT id FROM s WHERE NOT (n IN {_list(names.RUNTIME_NAMES)} OR {' OR '.join(f"starts_with(n, '{p}')" for p in names.RUNTIME_PREFIXES)})
""")
def tree_shake_filter(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    system = raw.where(names.is_system(F.lit(False), F.lit(False), F.col("raw"))).select("id")
    return raw.select("id").join(system, "id", "left_anti")


_TOKENS = f"""
tok AS (
  SELECT doc_id, source, unnest(list_filter(list_transform(regexp_extract_all(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z0-9]+'), lambda x: lower(x)),
    lambda t: len(t) BETWEEN 3 AND 24 AND regexp_matches(t, '^[a-z]') AND NOT (regexp_matches(t, '^[0-9a-f]+$') AND regexp_matches(t, '[0-9]')) AND t NOT IN {_list(names.STOPWORDS)})) AS token
  FROM documents WHERE text IS NOT NULL AND NOT (text <> '' AND regexp_matches(text, '{names.RUNTIME_TEXT}')))"""


@query(f"WITH {_TOKENS} SELECT doc_id, token, count(*) AS n FROM tok GROUP BY doc_id, token")
def tokenize_docs(spark, sf_dir):
    docs = star.table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.explode(names.tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query(f"""
WITH {_TOKENS}, c AS (SELECT source AS cluster, token, count(*) AS tf FROM tok WHERE source IS NOT NULL GROUP BY source, token),
m AS (SELECT cluster, sum(tf) AS mass, count(*) AS v FROM c GROUP BY cluster), d AS (SELECT token, count(DISTINCT cluster) AS df FROM c GROUP BY token),
s AS (SELECT c.cluster, token, (tf + 0.5) / (mass + 0.5 * v) * ln(1 + (SELECT count(*) FROM m) / df) AS score FROM c JOIN m USING (cluster) JOIN d USING (token))
SELECT cluster, token, round(score, 9) AS score FROM s QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, token) <= 8
""")
def ctfidf_terms(spark, sf_dir):
    """The eight most telling words of each source."""
    from pyspark.sql import Window

    docs = star.table(spark, sf_dir, "documents").where("source is not null").select("source", "text")
    counts = docs.select(F.col("source").alias("cluster"), F.explode(names.tokens(F.col("text"))).alias("token")).groupBy("cluster", "token").agg(F.count("*").alias("tf"))
    scores = labels.term_scores(counts).withColumn("score", F.round("score", 9))
    best = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "token"))
    return scores.withColumn("_k", best).where("_k <= 8").drop("_k")


_STEM = names.SOURCE_FILE.replace("\\\\", "\\\\")


@query(f"""
WITH f AS (SELECT page_id, replace(split_part(url, '?', 1), '.html', ['.cpp', '.txt', '.rs', '.py'][1 + page_id % 4]) || CASE WHEN page_id % 3 = 0 THEN '.h' ELSE '' END AS path FROM pages)
SELECT page_id, path, regexp_extract(path, '{_STEM}', 1) AS stem FROM f
""")
def source_stem(spark, sf_dir):
    p = star.table(spark, sf_dir, "pages")
    ending = F.element_at(F.array(F.lit(".cpp"), F.lit(".txt"), F.lit(".rs"), F.lit(".py")), (1 + F.col("page_id") % 4).cast("int"))
    path = F.concat(F.replace(F.split_part("url", F.lit("?"), F.lit(1)), F.lit(".html"), ending), F.when(F.col("page_id") % 3 == 0, ".h").otherwise(""))
    return p.select("page_id", path.alias("path"), names.source_stem(path).alias("stem"))


@query(r"""
WITH m AS (SELECT p_partkey AS id, (CASE WHEN p_partkey % 5 = 0 THEN '(anonymous namespace)::' ELSE '' END) || replace(p_name, ' ', '::') ||
             CASE p_partkey % 3 WHEN 0 THEN '<int, vec<char>>::Run(int)' WHEN 1 THEN '::' || p_brand || '::go()' ELSE '' END AS dm FROM part),
a AS (SELECT id, regexp_replace(dm, '^(?:\(anonymous namespace\)::)+', '') AS s FROM m),
b AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(s, '<[^<>]*>', '', 'g'), '<[^<>]*>', '', 'g'), '\(.*$', '') AS s FROM a),
c AS (SELECT id, string_split(s, '::') AS p FROM b),
d AS (SELECT id, CASE WHEN len(p) > 2 THEN p[1] || '::' || p[2] ELSE p[1] END AS k, p FROM c)
SELECT id, CASE WHEN len(p) < 2 OR p[1] = '' OR len(k) > 40 THEN '' ELSE lower(k) END AS module FROM d
""")
def module_key(spark, sf_dir):
    k = F.col("p_partkey")
    dm = F.concat(
        F.when(k % 5 == 0, "(anonymous namespace)::").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("::")),
        F.when(k % 3 == 0, "<int, vec<char>>::Run(int)").when(k % 3 == 1, F.concat(F.lit("::"), F.col("p_brand"), F.lit("::go()"))).otherwise(""),
    )
    return star.table(spark, sf_dir, "part").select(k.alias("id"), names.module_key(dm).alias("module"))


_CATS = ", ".join(f"('{t}', '{c}')" for t, c in names.category_rows())


_LABELS = f"""cat(token, category) AS (VALUES {_CATS}),
word_ AS (SELECT p_partkey AS node, p_size AS cluster, (SELECT list(token ORDER BY token) FROM cat)[1 + (p_partkey * 7) % 200] AS word, p_name, p_type FROM part),
tok AS (
  SELECT node, cluster, unnest(string_split(p_name, ' ')) AS token, 3.0 AS w FROM word_ UNION ALL SELECT node, cluster, lower(p_type), 1.0 FROM word_
  UNION ALL SELECT node, cluster, 'kit' || cluster // 2, 4.0 FROM word_ UNION ALL SELECT node, cluster, 'part' || cluster // 2, 4.0 FROM word_ WHERE node % 4 <> 0
  UNION ALL SELECT node, cluster, word, 1.5 FROM word_ WHERE word IS NOT NULL),
c AS (SELECT cluster, token, CAST(sum(w) AS DOUBLE) AS tf FROM tok GROUP BY 1, 2), m AS (SELECT cluster, sum(tf) AS mass, count(*) AS v FROM c GROUP BY 1), d AS (SELECT token, count(*) AS df FROM c GROUP BY 1),
sc AS (SELECT cluster, token, round((tf + 0.5) / (mass + 0.5 * v) * ln(1 + (SELECT count(*) FROM m) / df), 9) AS score FROM c JOIN m USING (cluster) JOIN d USING (token)),
rk AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, token) AS k FROM sc WHERE cluster <> 1),
has AS (SELECT cluster, node, count(DISTINCT token) AS n FROM tok JOIN rk USING (cluster, token) WHERE k <= 2 GROUP BY 1, 2),
big AS (SELECT cluster, (SELECT string_agg(token, '-' ORDER BY k) FROM rk WHERE rk.cluster = has.cluster AND k <= 2) AS term FROM has GROUP BY cluster HAVING count(*) FILTER (n = 2) / count(*) >= 0.6),
opt AS (
  SELECT cluster, row_number() OVER (ORDER BY max(score) DESC, cluster) AS place, min_by(token, k) AS best, list_concat(coalesce((SELECT [term] FROM big WHERE big.cluster = rk.cluster), []), list(token ORDER BY k)) AS terms
  FROM rk GROUP BY cluster),
claim(place, cluster, first_, used) AS (
  SELECT CAST(0 AS BIGINT), -1, '', CAST([] AS VARCHAR[])
  UNION ALL
  SELECT place, cluster, first_, list_append(used, first_) FROM (
    SELECT o.place, o.cluster, used, coalesce(list_filter(terms, lambda t: NOT list_contains(used, t))[1], best) AS first_ FROM claim JOIN opt o ON o.place = claim.place + 1)),
more_ AS (SELECT cluster, string_agg(token, ' · ' ORDER BY k) AS more FROM (
  SELECT rk.cluster, token, k FROM rk JOIN claim USING (cluster) WHERE NOT contains(first_, token) QUALIFY row_number() OVER (PARTITION BY rk.cluster ORDER BY k) <= 2) GROUP BY cluster),
kind AS (SELECT cluster, category, min(k) AS k, count(*) AS n FROM rk JOIN cat USING (token) GROUP BY 1, 2 HAVING min(k) <= 8),
hit AS (SELECT DISTINCT cluster, category FROM word_ JOIN cat ON token = word WHERE node % 11 = 0 AND len(word) BETWEEN 3 AND 24 AND word NOT IN {_list(names.STOPWORDS)}),
cat_ AS (SELECT cluster, min_by(category, k) AS category FROM kind WHERE category NOT IN {_list(names.SENSITIVE)} OR n >= 2 OR (cluster, category) IN (FROM hit) GROUP BY cluster),
size_ AS (SELECT p_size AS cluster, count(*) AS n FROM part GROUP BY 1)"""


@query(f"""
WITH RECURSIVE {_LABELS}
SELECT z.cluster, CASE WHEN z.cluster = 1 THEN 'Utilities' ELSE coalesce(first_ || coalesce(' · ' || more, ''), 'cluster-' || (z.cluster + 1)) END || ' (' || n || ' funcs)' AS label,
  CASE WHEN z.cluster = 1 THEN 'stl_util' ELSE coalesce(category, '') END AS category
FROM size_ z LEFT JOIN claim USING (cluster) LEFT JOIN more_ ON more_.cluster = z.cluster LEFT JOIN cat_ ON cat_.cluster = z.cluster
""")
def cluster_labels(spark, sf_dir):
    """Parts of a size are a subsystem, told by words of their names, types and a word with a category; neighbouring sizes compete for the same terms."""
    p = star.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_size").alias("cluster"), "p_name", "p_type")
    words = F.array(*[F.lit(t) for t, _ in names.category_rows()])
    p = p.withColumn("word", F.get(words, ((F.col("node") * 7) % 200).cast("int")))
    both = F.floor(F.col("cluster") / 2)
    rows = F.filter(F.concat(
        F.transform(F.split("p_name", " "), lambda t: F.struct(t.alias("token"), F.lit(3.0).alias("weight"))),
        F.array(F.struct(F.lower("p_type").alias("token"), F.lit(1.0).alias("weight")), F.struct(F.concat(F.lit("kit"), both).alias("token"), F.lit(4.0).alias("weight")),
                F.struct(F.when(F.col("node") % 4 != 0, F.concat(F.lit("part"), both)).alias("token"), F.lit(4.0).alias("weight")), F.struct(F.col("word").alias("token"), F.lit(1.5).alias("weight"))),
    ), lambda x: x["token"].isNotNull())
    tokens = stash(p.select("node", "cluster", F.explode(rows).alias("r")).select("node", "cluster", "r.*"), "tokens")
    clusters = p.groupBy("cluster").agg(F.count("*").alias("size")).withColumn("utility", F.col("cluster") == 1)
    modules = p.where("node % 11 = 0 and word is not null").select("cluster", F.concat(F.lit("lib"), "word", F.lit(".so")).alias("module"))
    return labels.labels(tokens, clusters, modules)


@query(f"""
WITH cat(token, category) AS (VALUES {_CATS}), w AS (SELECT p_partkey AS id, (SELECT list(token ORDER BY token) FROM cat)[1 + (p_partkey * 7) % 200] AS token FROM part)
SELECT id, w.token, category, category IN {_list(names.SENSITIVE)} AS sensitive FROM w LEFT JOIN cat USING (token) WHERE w.token IS NOT NULL
""")
def category(spark, sf_dir):
    words = F.array(*[F.lit(t) for t, _ in names.category_rows()])
    w = star.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.try_element_at(words, (1 + F.col("p_partkey") * 7 % 200).cast("int")).alias("token")).where("token is not null")
    c = names.token_category(F.col("token"))
    return w.select("id", "token", c.alias("category"), c.isin(*names.SENSITIVE).alias("sensitive"))


@query(r"""
WITH m AS (SELECT page_id, '/usr/lib/' || CASE WHEN page_id % 2 = 0 THEN 'lib' ELSE '' END || split_part(split_part(url, '/', 3), '.', 1) || '.so.' || page_id AS module FROM pages),
t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(module), '^.*[/\\]', ''), '^lib', ''), '\..*$', '') AS s FROM m)
SELECT page_id, CASE WHEN len(s) BETWEEN 3 AND 24 AND s NOT IN STOP THEN s ELSE '' END AS token FROM t
""".replace("STOP", _list(names.STOPWORDS)))
def import_module_tokens(spark, sf_dir):
    host = F.split_part(F.split_part("url", F.lit("/"), F.lit(3)), F.lit("."), F.lit(1))
    module = F.concat(F.lit("/usr/lib/"), F.when(F.col("page_id") % 2 == 0, "lib").otherwise(""), host, F.lit(".so."), F.col("page_id"))
    return star.table(spark, sf_dir, "pages").select("page_id", names.import_module_token(module).alias("token"))


_REGS = ["al", "AH", "ax", "eax", "rax", "spl", "sp", "esi", "dil", "r8d", "r15w", "r9b", "ymm3", "zmm11", "xmm0", "rip", "eflags", "k1"]
_REG_SQL = "[" + ", ".join(f"'{r}'" for r in _REGS) + "]"


@query(f"""
WITH r AS (SELECT p_partkey AS id, lower({_REG_SQL}[1 + p_partkey % {len(_REGS)}]) AS reg FROM part),
n AS (SELECT id, reg, CASE WHEN reg IN ('al', 'ah', 'ax', 'eax') THEN 'rax' WHEN reg IN ('spl', 'sp') THEN 'rsp' WHEN reg = 'esi' THEN 'rsi' WHEN reg = 'dil' THEN 'rdi'
  ELSE regexp_replace(regexp_replace(reg, '^(r[0-9]+)[bwd]$', '\\1'), '^[xyz]mm([0-9]+)$', 'xmm\\1') END AS parent FROM r)
SELECT id, reg, CASE WHEN parent IN ('rsp', 'rip', 'eflags', 'flags') THEN NULL ELSE parent END AS parent FROM n
""")
def parent_registers(spark, sf_dir):
    reg = F.lower(F.element_at(F.array(*[F.lit(r) for r in _REGS]), (1 + F.col("p_partkey") % len(_REGS)).cast("int")))
    return star.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), reg.alias("reg"), names.parent_register(reg).alias("parent"))


@query(f"""
WITH {FUNC}
SELECT id, '0x' || upper(to_hex(start_)) AS address, 'f_' || lower(to_hex(start_)) AS node, start_ - 4194304 AS rva,
  CASE WHEN id % 3 = 0 THEN '.' || name WHEN id % 3 = 1 THEN '@[0x' || upper(to_hex(size)) || ':?]' ELSE '' END AS slice,
  CASE id % 4 WHEN 0 THEN 'L(' || name || ')' WHEN 1 THEN 'G(' || name || ')' WHEN 2 THEN 'C(0x0)' ELSE 'U()' END AS origin,
  ' {{conf=med,n=' || size || '}}' AS meta
FROM func
""")
def notations(spark, sf_dir):
    f = star.functions(spark, sf_dir)
    third, fourth = F.col("id") % 3, F.col("id") % 4
    kind = F.when(fourth == 0, "L").when(fourth == 1, "G").when(fourth == 2, "C").otherwise("D")
    return f.select(
        "id", notation.hex_upper(F.col("start")).alias("address"), F.concat(F.lit("f_"), notation.hex_lower(F.col("start"))).alias("node"), notation.rva(F.col("start"), F.lit(4194304)).alias("rva"),
        notation.slice_of(F.when(third == 0, F.col("name")), F.when(third == 1, F.col("size")), F.lit(None).cast("long")).alias("slice"),
        notation.origin_of(kind, F.col("name")).alias("origin"), notation.meta_of(F.create_map(F.lit("n"), F.col("size").cast("string"), F.lit("conf"), F.lit("med"))).alias("meta"),
    )


@query(r"""
SELECT conv_id, turn, replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') AS escaped,
  replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html,
  CASE WHEN role = 'user' THEN ';' ELSE '; ' || text END AS line
FROM conversations
""")
def escapes(spark, sf_dir):
    c = star.table(spark, sf_dir, "conversations")
    line = notation.comment_to_assembly(F.when(F.col("role") == "user", "//").otherwise(F.col("text")))
    return c.select("conv_id", "turn", notation.c_escape(F.col("text")).alias("escaped"), notation.html_escape(F.col("text")).alias("html"), line.alias("line"))


@query("""
WITH s AS (SELECT p_partkey AS id, trim(unnest(string_split_regex(CASE WHEN p_partkey % 2 = 0 THEN '0x40, ' || p_name || ' | face' ELSE p_brand || ',beef' END, '[,|]'))) AS spec FROM part)
SELECT id, spec, regexp_matches(spec, '^(?:0[xX])?[0-9a-fA-F]+$') AS is_address FROM s WHERE spec <> ''
""")
def seed_specs(spark, sf_dir):
    """Seeds as a user writes them: hexadecimal-looking ones are addresses, all others names."""
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("0x40, "), F.col("p_name"), F.lit(" | face"))).otherwise(F.concat(F.col("p_brand"), F.lit(",beef")))
    s = star.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(F.split(text, "[,|]")).alias("spec"))
    s = s.withColumn("spec", F.trim("spec")).where("spec <> ''")
    return s.select("id", "spec", F.col("spec").rlike("^(?:0[xX])?[0-9a-fA-F]+$").alias("is_address"))


@query(r"""
SELECT conv_id, turn, len(text) AS n FROM conversations
WHERE len(text) BETWEEN 4 AND 256 AND len(regexp_replace(text, '[^\x20-\x7e]', '', 'g')) * 10 >= len(text) * 9
""")
def string_literals(spark, sf_dir):
    """Texts that would pass for string literals: 4 to 256 characters, nine tenths of them printable."""
    c = star.table(spark, sf_dir, "conversations")
    n = F.length("text")
    return c.where(n.between(4, 256) & (F.length(F.regexp_replace("text", r"[^\x20-\x7e]", "")) * 10 >= n * 9)).select("conv_id", "turn", n.cast("long").alias("n"))
