"""Names of functions, modules and source files, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Runtime functions by exact name.
RUNTIME_NAMES = """abort abs accept acos aligned_alloc alloc alloca asin assert atan atexit atof atoi atol atoll bsearch
calloc ceil cfree chkstk clock close connect cos exit exp fabs fclose fdopen fflush fgetc fgets floor fopen fprintf
fputc fputs fread free freopen fscanf fseek fseeko ftell ftello fwrite getc getchar getenv gets isalnum isalpha isdigit
islower isspace isupper labs ldexp libc_start_main log lseek maincrtstartup malloc memcmp memchr memcpy memmove memset
mmap munmap nanosleep open perror poll posix_memalign pow printf putc putchar puts qsort rand read realloc recv rewind
scanf security_check_cookie select send setenv sin sleep snprintf socket sprintf srand sscanf stack_chk_fail strcasecmp
strcat strchr strcmp strcpy strdup strerror strlen strncasecmp strncat strncmp strncpy strndup strnlen strrchr strstr
strtod strtok strtol strtoll strtoul strtoull tan time tolower toupper unsetenv usleep vfprintf vfscanf vprintf vscanf
vsnprintf vsprintf vsscanf winmaincrtstartup write""".split() + ["operator delete", "operator new"]
#: Beginnings of runtime names.
RUNTIME_PREFIXES = ["std::", "operator delete", "operator new", "pthread_", "dispatch_", "objc_", "cxa_", "asan_", "ubsan_", "tsan_", "msan_", "sanitizer_"]
#: Names of entry points.
ENTRY_NAMES = ["main", "wmain", "winmain", "wwinmain", "dllmain", "start", "thread_start", "threadproc", "thread_proc", "start_routine"]
#: Words that say nothing about a function.
STOPWORDS = """the for and from with that this not into get set put has use via out off all any ida std gnu cxx abi
cxxabi libc ptr ref val value view iter impl detail const void char int bool long auto size idx index tmp obj self args
arg ret res begin end first last next prev true false null nullptr nullsub sub loc var fld qword""".split()
#: Endings of source files.
SOURCE_EXTENSIONS = "cpp cc cxx c hpp hxx hh h rs go py java cs swift m mm".split()
#: Categories by word; of a word in two rows the first counts.
CATEGORIES = {
    "decompiler": "decompile decompiler ctree pseudocode hexrays qflow microcode mba cexpr citem visitor expression",
    "types": "type types udt tinfo typedef declaration decl enum struct member udm collector prototype typeinfo field sizeof",
    "graph": "graph dot cluster subsystem centrality louvain digraph entryness ranker modularity",
    "output": "writer render emit output dump serialize escape indent pretty code",
    "xref": "xref cref dref reference crossref callgraph caller callee fanin fanout",
    "disasm": "disasm insn instruction mnem opcode operand mnemonic prologue epilogue",
    "segment": "segment segm section memmap mapping relocation fixup loader header binary",
    "register": "register liveness regs clobber incoming outgoing frame argloc",
    "io": "ofstream fopen filepath filesystem clipboard stdout stderr ifstream pathname tempfile",
    "cli": "argv argc option usage getopt cmdline cli subcommand helptext",
    "provenance": "ptn ptnemitter provenance alias aliaschain origin summary taint dataflow liveset",
    "crypto": "crypto aes rsa hmac cipher x509 ecdsa blake chacha keccak",
    "network": "socket getaddrinfo recvfrom sendto winsock epoll sockaddr htons setsockopt wsastartup",
    "compression": "zlib inflate deflate lzma zstd huffman brotli gunzip unzip",
    "database": "sqlite cursor resultset prepared rowid schema btree pager vacuum",
    "text": "format formatter formatting regex lexer parser grammar unicode codepoint tokenizer syntax json nlohmann",
}
#: Categories that need more than one sign.
SENSITIVE = ("network", "crypto", "compression", "database")

#: Prefixes and parts of names that runtime and low-level functions have, as regular expressions of both Java and RE2.
LEADING = r"^(?:j_|__imp_|_imp_|imp_|\.|_)+"
RUNTIME_TEXT = r"^(?:_Z|__|std::|`|\.)|_M_|__gnu_cxx|cxxabi|__cxa|gxx_personality|_Unwind|operator|GLIBC|GCC_|CXXABI|GLIBCXX|^[A-Z0-9]{4,}$|^[A-Z0-9]{4,}[h.]$"
RUNTIME_DEMANGLED = r"^(?:std::|__gnu_cxx|__cxxabiv1|__cxa|operator new|operator delete|non-virtual thunk|virtual thunk|typeinfo|vtable for|VTT for|guard variable)"
LOW_LEVEL = (
    r"_ITM_|TMClone|register_tm_clones|deregister_tm|register_frame|frame_dummy|__do_global|__libc_|__gmon|__gthread|__static_initialization"
    r"|^(?:_start|_init|_fini|__init|__fini|start|frexp[fl]?|ldexp[fl]?|modff?|scalbn|bcmp|qfree)$"
)
SOURCE_FILE = r"(?:^|[/\\])([A-Za-z0-9_-]{3,48})\.(?:" + "|".join(SOURCE_EXTENSIONS) + ")$"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def upper_ascii(c: Column) -> Column:
    return F.translate(c, _LOWER, _UPPER)


def canonical_name(c: Column) -> Column:
    """Lower case, without import and jump prefixes, up to the first ``@`` unless it starts with ``?``."""
    s = F.regexp_replace(lower_ascii(c), LEADING, "")
    return F.when(s.startswith("?"), s).otherwise(F.regexp_replace(s, "@.*$", ""))


def canonical_runtime_name(c: Column) -> Column:
    """As ``canonical_name``, cut at ``@@`` first, and without trailing ``_<digits>``."""
    s = F.regexp_replace(lower_ascii(c), LEADING, "")
    at = F.when(s.contains("@@"), F.regexp_replace(s, "@@.*$", "")).when(s.startswith("?"), s).otherwise(F.regexp_replace(s, "@.*$", ""))
    return F.regexp_replace(at, "(?:_[0-9]+)+$", "")


def is_runtime_canonical(c: Column) -> Column:
    """Whether a canonical name is a runtime function's; one pattern, so the name is evaluated once."""
    exact = "|".join(RUNTIME_NAMES)
    return F.coalesce(c.rlike(f"^(?:{exact})$|^(?:{'|'.join(RUNTIME_PREFIXES)})"), F.lit(False))


def is_runtime_name(c: Column) -> Column:
    return is_runtime_canonical(canonical_runtime_name(c))


def is_system(is_library: Column, is_thunk: Column, name: Column) -> Column:
    return F.coalesce(is_library, F.lit(False)) | F.coalesce(is_thunk, F.lit(False)) | is_runtime_name(name)


def is_entry_like(c: Column) -> Column:
    return F.coalesce(canonical_name(c).isin(ENTRY_NAMES), F.lit(False))


def is_runtime_text(c: Column) -> Column:
    return (c != "") & c.rlike(RUNTIME_TEXT)


def is_runtime_demangled(c: Column) -> Column:
    return c.rlike(RUNTIME_DEMANGLED)


def is_low_level_runtime(c: Column) -> Column:
    return c.rlike(LOW_LEVEL)


def is_hex_fragment(c: Column) -> Column:
    return c.rlike("^[0-9a-fA-F]+$") & c.rlike("[0-9]")


def tokens(c: Column) -> Column:
    """Lower-case words of 3 to 24 letters and digits, a letter first; split at other characters and camel case."""
    parts = F.regexp_extract_all(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), F.lit("[A-Za-z0-9]+"), 0)
    low = F.transform(parts, lower_ascii)
    keep = lambda t: (F.length(t) >= 3) & (F.length(t) <= 24) & t.rlike("^[a-z]") & ~is_hex_fragment(t) & ~t.isin(STOPWORDS)
    return F.when(is_runtime_text(c), F.array().cast("array<string>")).otherwise(F.filter(low, keep))


def source_stem(c: Column) -> Column:
    """Name of a source file without folder and extension; empty if the text is none."""
    return F.regexp_extract(c, SOURCE_FILE, 1)


def module_key(c: Column) -> Column:
    """First one or two ``::`` parts of a demangled name, without template arguments (nested up to four deep) and parameters."""
    s = F.regexp_replace(c, r"^(?:\(anonymous namespace\)::)+", "")
    for _ in range(4):
        s = F.regexp_replace(s, "<[^<>]*>", "")
    s = F.regexp_replace(F.regexp_replace(s, r"\(.*$", ""), "[<>]", "")
    parts = F.split(s, "::", -1)
    two = F.when(F.size(parts) > 2, F.concat_ws("::", F.slice(parts, 1, 2))).otherwise(parts[0])
    none = (F.size(parts) < 2) | (parts[0] == "") | (F.length(two) > 40)
    return F.when(none, "").otherwise(lower_ascii(two))


def import_module_token(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(lower_ascii(c), r"^.*[/\\]", ""), "^lib", "")
    s = F.regexp_replace(s, r"\..*$", "")
    return F.when((F.length(s) >= 3) & (F.length(s) <= 24) & ~s.isin(STOPWORDS), s).otherwise("")


def category_rows() -> list[tuple[str, str]]:
    """(token, category), each token once."""
    out: dict[str, str] = {}
    for category, words in CATEGORIES.items():
        for w in words.split():
            out.setdefault(w, category)
    return sorted(out.items())


def token_category(c: Column) -> Column:
    """Category of a token, null if it has none."""
    rows = category_rows()
    return F.element_at(F.create_map(*[F.lit(x) for r in rows for x in r]), c)


def parent_register(c: Column) -> Column:
    """The full register that a part belongs to; null for the stack pointer, program counter and flags."""
    s = F.regexp_replace(lower_ascii(c), "^e?([abcd])x$|^([abcd])[lh]$", "r$1$2x")
    s = F.regexp_replace(s, "^e?(sp|bp|si|di)l?$", "r$1")
    s = F.regexp_replace(s, "^(r[0-9]+)[bwd]$", "$1")
    s = F.regexp_replace(s, "^[xyz]mm([0-9]+)$", "xmm$1")
    return F.when(~s.isin("rsp", "rip", "eflags", "flags"), s)
