"""Secret scans by DataFrame functions alone.

Three kinds of spans come from patterns: assignments to telling names, access keys and long hexadecimal strings. A fourth,
``entropy``, comes from candidate strings: a window of ``WINDOW`` characters slides over each, character counts are updated
by the one that enters and the one that leaves, and the largest Shannon entropy met is held against the threshold of the
string's character class. Candidates on the allow-list, and those that are just a pattern's span, are left out.

Functions find matches but not their places; the texts between the matches, by ``split`` at the same pattern, give those.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import free_name

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# runs of these characters are met from their first on, so a least length in the pattern drops just the shorter ones
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
VALUE = 8
KINDS = ("assign", "access", "hex", "entropy")

# a value may follow ``=``, so that sign does not stop one from beginning
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}"
WINDOW = 20
#: Character classes, the narrowest first, with the entropy in bits a character from which a window is random.
CLASSES = ((r"^[0-9a-fA-F]+$", 2.9), (r"^[A-Z0-9]+$", 3.5), (r"^[a-z0-9]+$", 3.5), (r"^[A-Za-z0-9]+$", 3.7), (r"", 3.8))
#: Strings that look random but are no secrets: examples, counted sequences, UUIDs, paths of words. No group is repeated here: Java
#: walks those by recursion, as deep as the string has words.
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|changeme|xxxx|0123456789|abcdefgh|(.)\1{5}"
    r"|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^(?![/_-])(?!.*[/_-]{2})[A-Za-z/_-]*+[0-9]{0,4}$"
)
REDACTED = "<redacted>"
#: Code points of a piece of a text that is redacted.
PIECE = 4096

_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def _none() -> Column:
    return F.array().cast(_SPANS)


#: Steps of a scan: they double, so that arrays of 2 ** 30 elements are reached.
_STEPS = [1 << k for k in range(30)]


def _scan(items: Column, join: Callable[[Column, Column], Column]) -> Column:
    """``items`` with each element joined with all before it, in as many passes as doubling takes."""

    def step(done: Column, d: Column) -> Column:
        passed = F.transform(done, lambda x, i: F.when(i >= d, join(x, F.get(done, i - d))).otherwise(x))
        return F.when(d < F.size(done), passed).otherwise(done)

    return F.aggregate(F.array(*map(F.lit, _STEPS)), items, step)


def _places(text: Column, pattern: str, group: int, kind: int) -> Column:
    """Spans of the matches of ``pattern``, with what ``group`` matched; places count code points, and are the sums of the
    lengths of what lies before."""
    gaps, found, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    met = F.zip_with(F.zip_with(gaps, found, lambda g, f: F.struct((F.length(g) + F.length(f)).alias("end"), F.length(f).alias("size"))), values, lambda x, v: F.struct(x["end"].alias("end"), x["size"].alias("size"), v.alias("value")))
    ends = _scan(F.filter(met, lambda x: x["size"].isNotNull()), lambda x, before: F.struct((x["end"] + before["end"]).alias("end"), x["size"].alias("size"), x["value"].alias("value")))
    spans = F.transform(ends, lambda x: F.struct((x["end"] - x["size"]).alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(_none())


def _gain(c: Column) -> Column:
    """What one more of a character that occurs ``c`` times adds to the sum of n log2 n."""
    return (c + 1) * F.log2(c + 1) - F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0))


def top_entropy(text: Column) -> Column:
    """The largest entropy, in bits a character, of any WINDOW characters in a row of a string. Of the counts, only those of the
    character that enters and of the one that leaves change, and both are counted in the window."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))
    count = lambda window, code: F.size(F.filter(window, lambda c: c == code))

    def step(s: Column, code: Column) -> Column:
        full = F.size(s["last"]) >= WINDOW
        left = F.when(full, F.slice(s["last"], 2, WINDOW)).otherwise(s["last"])
        lost = F.when(full, _gain(count(left, F.element_at(s["last"], 1)))).otherwise(F.lit(0.0))
        total = s["sum"] - lost + _gain(count(left, code))
        met = F.when(F.size(left) == WINDOW - 1, F.log2(F.lit(float(WINDOW))) - total / WINDOW).otherwise(F.lit(0.0))
        return F.struct(F.array_append(left, code).alias("last"), total.alias("sum"), F.greatest(s["best"], met).alias("best"))

    start = F.struct(F.array().cast("array<int>").alias("last"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
    return F.aggregate(codes, start, step, lambda s: s["best"])


def _threshold(value: Column) -> Column:
    out = F.lit(CLASSES[-1][1])
    for pattern, least in reversed(CLASSES[:-1]):
        out = F.when(F.regexp_like(value, F.lit(pattern)), least).otherwise(out)
    return out


def _digest(spans: Column) -> Column:
    kind = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def annotate(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column of spans, whose name is returned: an array of (start, kind, end, value), sorted; kind numbers
    KINDS and end is exclusive. Spans of different kinds may overlap; one of entropy that equals another's is left out.
    A null or empty text has none; repeated rows have theirs each."""
    name, base, extra = free_name(docs, "_spans"), free_name(docs, "_base"), free_name(docs, "_candidates")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    assign = F.filter(_places(text, ASSIGN, 2, 0), lambda s: F.length(s["value"]) >= VALUE)
    out = docs.withColumn(base, F.array_sort(F.concat(assign, _places(text, ACCESS, 0, 1), _places(text, HEX, 0, 2))))
    out = out.withColumn(extra, F.filter(_places(text, CANDIDATE, 0, 3), lambda s: ~F.regexp_like(s["value"], F.lit(ALLOWED))))
    known = F.col(base)
    # sorted by place, a candidate that equals another span comes right after it
    placed = F.transform(F.concat(known, F.col(extra)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    out = out.withColumn(extra, F.when(F.size(extra) > 0, F.array_sort(placed)).otherwise(F.slice(placed, 1, 0)))
    before = lambda i: F.get(F.col(extra), i - 1)
    fresh = F.filter(F.col(extra), lambda s, i: (s["kind"] == 3) & ((i == 0) | (before(i)["start"] != s["start"]) | (before(i)["end"] != s["end"])))
    random = F.filter(fresh, lambda s: top_entropy(s["value"]) >= _threshold(s["value"]))
    random = F.transform(random, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    return out.withColumn(name, F.when(F.size(extra) == 0, known).otherwise(F.array_sort(F.concat(known, random)))).drop(base, extra), name


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each document, null ids and repeated rows too. Where
    spans begin at the same place, the kinds' order decides. No documents give no rows."""
    out, s = annotate(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter(F.col(s), lambda x: x["kind"] == k)).cast("long")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_digest(F.filter(F.col(s), lambda x: x["kind"] < 3)).cast("binary"), 256).alias("base_sha256"), _digest(F.col(s)).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of a secret replaced by a mark (spans that touch or overlap by one), and n_chars, where
    there is such a column, the new text's length in those rows. Columns as they were."""
    out, s = annotate(docs)
    text, cut, ends = F.col("text").cast("string"), free_name(out, "_cut"), free_name(out, "_ends")
    out = out.withColumn(cut, F.when(F.size(s) > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))
    # where each span begins, and the largest end up to it
    spans = F.transform(F.col(s), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    out = out.withColumn(ends, _scan(spans, lambda x, before: F.struct(x["start"].alias("start"), F.greatest(x["end"], before["end"]).alias("end"))))

    def between(a: Column, b: Column) -> Column:
        """Code points ``a`` to ``b``, from the pieces that hold them, so that a text isn't walked for each span."""
        first, last = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        piece = lambda k: F.coalesce(F.get(F.col(cut), k), F.lit(""))
        whole = F.array_join(F.slice(F.col(cut), first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        apart = F.concat(F.substring(piece(first), a - first * PIECE + 1, F.lit(PIECE)), whole, F.substring(piece(last), F.lit(1), b - last * PIECE))
        return F.when(first == last, F.substring(piece(first), a - first * PIECE + 1, b - a)).otherwise(apart)

    end = lambda i: F.when(i > 0, F.get(F.col(ends), i - 1)["end"]).otherwise(0)
    marked = F.transform(F.col(ends), lambda x, i: F.when((i == 0) | (x["start"] > end(i)), F.concat(between(end(i), x["start"]), F.lit(REDACTED))))
    hit, clean = F.size(s) > 0, free_name(out, "_clean")
    whole = F.concat(F.array_join(marked, ""), between(end(F.size(ends)), F.length(text)))
    out = out.withColumn(clean, F.when(hit, whole).otherwise(text))
    cols = []
    for c, kind in docs.dtypes:
        x = F.col(f"`{c}`")
        if c == "text":
            x = F.col(clean).alias(c)
        elif c == "n_chars":
            x = F.when(hit, F.length(clean).cast(kind)).otherwise(x).alias(c)
        cols.append(x)
    return out.select(*cols)
