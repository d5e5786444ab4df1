"""String helpers on columns; all stay inside the JVM."""

from pyspark.sql import functions as F

from newsmill import dims

# Unicode white space; Java's \s alone is ASCII
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def col(c):
    return F.col(c) if isinstance(c, str) else c


def let(value, fn):
    """Bind ``value`` once and use it many times in ``fn``, so the optimizer
    cannot copy a costly expression into every lambda step."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def strip(c):
    # the look-behind keeps a long inner run of blanks from being rescanned
    return F.regexp_replace(col(c), rf"^{SPACE}+|(?<!{SPACE}){SPACE}+\z", "")


def is_blank(c):
    """Null, empty, or white space only."""
    c = col(c)
    return c.isNull() | ~c.rlike(rf"[^\s\x1c-\x1f\x85\p{{Z}}]")


def clean_text(c):
    """Collapse white space, drop one trailing call-to-action of each kind."""
    out = F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), rf"{SPACE}+", " "))
    for suffix in dims.CLEAN_SUFFIXES:
        out = F.regexp_replace(out, rf"{suffix} *\z", "")
    return F.trim(out)


def ellipsis(c, limit, keep):
    """Longer than ``limit`` code points: first ``keep`` of them and dots."""
    c = col(c)
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(keep)), F.lit("..."))).otherwise(c)


def title_words(c):
    return F.initcap(F.replace(col(c), F.lit("_"), F.lit(" ")))


def lookup(key, table, pos=None, default=None):
    """A small fixed dictionary as a CASE expression."""
    key, out = col(key), None
    for name, value in table.items():
        value = F.lit(value if pos is None else value[pos])
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out.otherwise(F.lit(default)) if default is not None else out


def ratio(a, b):
    """a / b, and 0 where b is 0 or missing."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def pair_map(c):
    """``k=v; k=v`` text to a map, trimmed; the last value of a key wins and parts
    without ``=`` are dropped."""
    parts = F.filter(F.split(F.coalesce(col(c), F.lit("")), ";"), lambda p: p.contains("="))
    pairs = F.transform(
        parts,
        lambda p: F.struct(
            strip(F.substring_index(p, "=", 1)).alias("k"), strip(F.substr(p, F.instr(p, "=") + 1)).alias("v")
        ),
    )
    last = lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(let(pairs, last))
