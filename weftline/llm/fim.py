"""Fill-in-the-middle documents in DataFrame functions only, by escaped markers.

A delimiter is escaped in the text, then ``regexp_replace`` appends it after each
unit (a word with the white space before it, or the white space at the end). The
delimiters counted are the units; ``substring_index`` takes the units up to, and
from, a rank; what it gives loses its delimiters and is unescaped. All is one map
over documents: no shuffle, no Python worker, and a row holds a few copies of one
text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"\x20\x09-\x0D"
UNIT = f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+"
#: Neither is white space, so units stay what they are when a text is escaped.
MARK, ESCAPE = "\x01", "\x02"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


def _swap(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escaped(c: Column) -> Column:
    return _swap(_swap(c, ESCAPE, ESCAPE + "e"), MARK, ESCAPE + "m")


def unescaped(c: Column) -> Column:
    """Without the delimiters that were appended, and with those of the text."""
    return _swap(_swap(_swap(c, MARK, ""), ESCAPE + "m", MARK), ESCAPE + "e", ESCAPE)


def up_to(marked: Column, k: Column) -> Column:
    return F.call_function("substring_index", marked, F.lit(MARK), k.cast("int"))


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n (units), form, prefix_chars, middle_chars and output.

    The first four groups of eight hexadecimal digits of the SHA-256 of
    ``<seed>:<id>`` decide: two of them, modulo n + 1, the units after which prefix
    and middle end; the third whether the document stays ``plain`` (as it does if it
    is empty or holds one of the three markers); the fourth between ``spm`` (suffix,
    prefix, middle) and ``psm``. output is the text, or its three parts behind their markers.

    A null text is an empty one and stays so in ``text_col``; a null id is hashed as
    an empty string. Rows that repeat an id share its draws. Very long texts are cut
    whole. Other columns pass through; an input column with the name of a new one, in
    any case, is replaced. An empty table gives an empty one.
    """
    other = [c for c in docs.columns if c.lower() not in ADDED]
    row = F.struct(*[F.col(f"`{c}`") for c in other]) if other else F.lit(None)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(row.alias("row"), text.alias("text"), digest.alias("digest"))
    marked = base.withColumn("marked", F.regexp_replace(escaped(F.col("text")), UNIT, "$0" + MARK))
    counted = marked.withColumn("n", (F.octet_length("marked") - F.octet_length(_swap(F.col("marked"), MARK, ""))).cast("long"))

    def draw(k: int) -> Column:
        return F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long")

    one, two = draw(0) % (F.col("n") + 1), draw(1) % (F.col("n") + 1)
    plain = (F.col("text") == "") | (draw(2) % 100 >= percent)
    for m in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains(F.col("text"), F.lit(m))
    form = F.when(plain, "plain").when(draw(3) % 100 < spm_percent, "spm").otherwise("psm")
    drawn = counted.select("row", "text", "marked", "n", form.alias("form"), F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))

    m, a, b, n = F.col("marked"), F.col("a"), F.col("b"), F.col("n")
    # Plain texts are not cut.
    cut = F.when(F.col("form") != "plain", F.struct(
        unescaped(up_to(m, a)).alias("prefix"),
        unescaped(up_to(up_to(m, b), a - b)).alias("middle"),
        unescaped(up_to(m, b - n - 1)).alias("suffix")))
    parts = drawn.select("row", "text", "n", "form", cut.alias("cut"))
    prefix, middle, suffix = (F.col("cut").getField(x) for x in ("prefix", "middle", "suffix"))
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    done = parts.select("row", "n", "form", F.length(prefix).cast("long").alias("prefix_chars"), F.length(middle).cast("long").alias("middle_chars"), output.alias("output"))
    return done.select(*[F.col("row").getField(c).alias(c) for c in other], *ADDED)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of. No marker can begin within
    another's end, so the first of each is the one that was put there."""
    def before(c: Column, mark: str) -> Column:
        return F.substring_index(c, mark, 1)

    def after(c: Column, mark: str) -> Column:
        at = F.instr(c, F.lit(mark))
        return F.substr(c, at + len(mark))

    psm = F.concat(before(after(output, PREFIX), SUFFIX), after(after(output, SUFFIX), MIDDLE), before(after(output, SUFFIX), MIDDLE))
    spm = F.concat(before(after(output, PREFIX), MIDDLE), after(after(output, PREFIX), MIDDLE), before(after(output, SUFFIX), PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
