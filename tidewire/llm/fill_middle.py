"""Fill-in-the-middle examples by markers injected into the text, in DataFrame functions only.

A delimiter, U+0001, is escaped where the text itself has it; then it is appended
to every unit, counted, and used to pick the units of a rank: the text before the
n-th delimiter, or after the n-th from the end. The parts are unescaped and put
together in the order that the document's hash asks for. An escaped character
still counts as the one unit that it was. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import fresh, quoted

#: A unit of escaped text: a run of A-Z and a-z, or any other code point, escaped or not.
UNIT = r"[A-Za-z]++|\x02[12]|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK, ESCAPE = "\x01", "\x02"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "2")), F.lit(MARK), F.lit(ESCAPE + "1"))


def unescaped(part: Column) -> Column:
    bare = F.replace(part, F.lit(MARK), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPE + "1"), F.lit(MARK)), F.lit(ESCAPE + "2"), F.lit(ESCAPE))


def units(part: Column, count: Column) -> Column:
    """The first ``count`` units of marked text, or the last -``count`` of one without its last mark; none for 0."""
    return F.call_function("substring_index", part, F.lit(MARK), count.cast("int"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of ``fill_middle`` was made of. Markers occur neither in the parts nor across their edges, so each is where it was put."""
    psm = F.regexp_replace(output, rf"(?s)\A{PREFIX}(.*){SUFFIX}(.*){MIDDLE}(.*)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{SUFFIX}(.*){PREFIX}(.*){MIDDLE}(.*)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_middle(
    docs: DataFrame,
    keep: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: str = "1",
    plain_percent: int = 10,
    spm_percent: int = 20,
) -> DataFrame:
    """``keep`` (all columns by default) with ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars``,
    ``middle_chars`` (code points, null if plain) and ``output``.

    Two cuts and the form come from the SHA-256 of seed, colon and id, so reruns and rows of one id
    agree; a null id hashes as an empty one. Null texts are empty, and empty texts stay plain, as do
    those that hold a marker. Very long texts are handled whole, in memory of a few times their size.
    Result columns replace columns of their name; others may have any name.
    """
    keep = docs.columns if keep is None else keep
    names = {n: fresh(f"_{n}", docs) for n in ("text", "hash", "marked", "n", "low", "high", "form", "prefix", "middle", "suffix", "body")}
    col = {n: F.col(quoted(x)) for n, x in names.items()}
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit(""))).cast("binary"), 256)
    part = lambda k: F.conv(F.substring(col["hash"], 8 * k + 1, 8), 16, 10).cast("long")

    out = docs.withColumn(names["text"], F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))).withColumn(names["hash"], digest)
    marked = F.regexp_replace(escaped(col["text"]), UNIT, "$0" + MARK)
    out = out.withColumn(names["marked"], marked)
    # the escaped text has no mark, so the marks are what is longer
    out = out.withColumn(names["n"], (F.length(col["marked"]) - F.length(F.replace(col["marked"], F.lit(MARK), F.lit("")))).cast("long"))
    cuts = [part(k) % (col["n"] + 1) for k in (0, 1)]
    has_marker = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        has_marker = has_marker | F.contains(col["text"], F.lit(marker))
    plain = (col["text"] == "") | has_marker | (part(2) % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(part(3) % 100 < spm_percent, "spm").otherwise("psm")
    out = out.withColumns({names["low"]: F.least(*cuts), names["high"]: F.greatest(*cuts), names["form"]: form})
    out = out.withColumns({names["prefix"]: units(col["marked"], col["low"]), names["middle"]: units(col["marked"], col["high"]), names["body"]: units(col["marked"], col["n"])})
    out = out.withColumns({
        names["prefix"]: unescaped(col["prefix"]),
        names["middle"]: unescaped(units(col["middle"], col["low"] - col["high"])),
        names["suffix"]: unescaped(units(col["body"], col["high"] - col["n"])),
    })
    psm = F.concat(F.lit(PREFIX), col["prefix"], F.lit(SUFFIX), col["suffix"], F.lit(MIDDLE), col["middle"])
    spm = F.concat(F.lit(SUFFIX), col["suffix"], F.lit(PREFIX), col["prefix"], F.lit(MIDDLE), col["middle"])
    made = {
        "n": col["n"],
        "form": col["form"],
        "prefix_chars": F.when(col["form"] != "plain", F.length(col["prefix"])).cast("long"),
        "middle_chars": F.when(col["form"] != "plain", F.length(col["middle"])).cast("long"),
        "output": F.when(col["form"] == "psm", psm).when(col["form"] == "spm", spm).otherwise(col["text"]),
    }
    return out.select(*[F.col(quoted(c)) for c in keep if c not in made], *[c.alias(n) for n, c in made.items()])
