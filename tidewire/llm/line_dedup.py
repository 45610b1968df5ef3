"""Line deduplication: an exact set-similarity join, by DataFrame functions only.

A line is the set of its words; equal sets are one node from the start. The hashes of a
line's words, in order, are cut into runs by ranges of values, as many as words may differ
at the threshold and two more. A word that differs spoils one run, so two lines at the
threshold have a run in common; and if a line's runs are put in an order that all lines
share (here the letters in them, as long runs are rare), it is enough to look at one
run more than words may differ. As the number of ranges depends on length, a line has
runs for each class of lengths that its partners may have. A line with too few
runs adds single words, the longest first. Runs are the join's key; the length filter and a
parity filter (bits that differ in signatures, of which each word flips one, bound the words
that differ) drop pairs that cannot reach the threshold. A semi-join keeps the nodes with
some partner left, so its result does not grow with the pairs. Only their texts are
fetched, and Jaccard similarity over all their words decides: first against the earliest
node of each run, then against a drawn one, which settles nearly all members of large groups,
then the nodes still open against all. A line goes if some earlier line (by document,
then place) matches it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import discard, fresh, materialize, quoted, text_key

#: Nodes with more than one in HEAVY of all lines, fewer than HEAVY of them, are broadcast to the lines.
HEAVY = 4096
BLANKS = " \t\r\f\v"
#: Bits of the parity in the signature of all nodes; the number of words is above them, up to MANY.
PARITY, MANY = 54, 1023
#: The wider signature of nodes whose texts are fetched, 64 bits each.
WIDE = ("wide0", "wide1")


def word_set(line: Column) -> Column:
    """The distinct words of a lower-case line without blanks around it, as sorted numbers: 56 bits of a hash, then 8 of the length."""
    low = F.lit(255).cast("long")
    code = lambda w: F.xxhash64(w).bitwiseAND(F.lit(-256).cast("long")).bitwiseOR(F.least(F.octet_length(w).cast("long"), low))
    return F.sort_array(F.array_distinct(F.transform(F.split(line, f"[{BLANKS}]+"), code)))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once for each row."""
    return F.transform(F.array(value), use)[0]


def _floor(x: Column) -> Column:
    return F.floor(x + 1e-9).cast("int")


def _class(n: Column) -> Column:
    """Lengths from 2 ** c to 2 ** (c + 1) - 1 are class c."""
    return F.length(F.bin(n.cast("long"))) - 1


def _token(letters: Column, digest: Column) -> Column:
    """Smaller for more letters; 52 bits of the digest."""
    return F.shiftleft(2047 - F.least(letters, F.lit(2047).cast("long")), 52).bitwiseOR(F.shiftrightunsigned(digest, 12))


def prefixes(words: Column, t: float) -> Column:
    """The tokens, 32 bits each, of which lines at the threshold have one in common: runs of words, for each class of lengths."""
    rate, n = (1 - t) / (1 + t), F.size(words)
    length = lambda x: x.bitwiseAND(F.lit(255).cast("long"))

    def of_class(c: Column) -> Column:
        top = F.call_function("shiftleft", F.lit(2), c) - 1
        return _let(F.struct(_floor((n + F.least(top, _floor(n / t))) * rate).alias("differ"), (_floor(top * 2 * rate) + 2).cast("long").alias("ranges")), lambda at: F.when(at["differ"] > 0, of_ranges(c, at)).otherwise(F.array().cast("array<long>")))

    def of_ranges(c: Column, at: Column) -> Column:
        places = F.transform(words, lambda x: F.shiftright(F.shiftright(x, 32) * at["ranges"], 32))
        new = lambda p, i: F.coalesce(F.get(p, i - 2) != F.get(p, i - 1), F.lit(True))
        starts = _let(places, lambda p: F.filter(F.sequence(F.lit(1), n), lambda i: new(p, i)))
        # a run is told by its first and last word; what lies between is left to the comparison of sets
        def token(begin: Column, s: Column, i: Column) -> Column:
            first, last = F.get(words, s - 1), F.get(words, F.coalesce(F.get(begin, i + 1), n + 1) - 2)
            return _token(length(first) + length(last), F.xxhash64(first, last, c))

        tokens = _let(starts, lambda begin: F.transform(begin, lambda s, i: token(begin, s, i)))
        single = F.transform(words, lambda x: _token(length(x), F.xxhash64(x, c, F.lit(1))))
        most = at["differ"] + 1
        first = lambda x: F.slice(F.sort_array(x), F.lit(1), most)
        return _let(tokens, lambda x: F.when(F.size(x) >= most, first(x)).otherwise(F.concat(x, first(single))))

    classes = F.sequence(_class(n), _class(_floor(n / t)))
    return F.transform(F.flatten(F.transform(classes, of_class)), lambda x: F.shiftright(F.shiftleft(x, 32), 32).cast("int"))


def _flipped(words: Column, bits: int, of: Callable[[Column], Column], only: Callable[[Column], Column] | None = None) -> Column:
    """Bits of which each word flips one."""
    one = F.lit(1).cast("long")
    flip = lambda x: F.call_function("shiftleft", one, F.pmod(of(x), F.lit(bits).cast("long")).cast("int"))
    return F.aggregate(F.filter(words, only) if only else words, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(flip(x)))


def _split_lines(docs: DataFrame) -> DataFrame:
    """(id, key, line_no, line): lower case, without blanks around; lines without words are left out."""
    lines = docs.select("id", "key", F.posexplode(F.split(F.lower("text"), "\n")).alias("line_no", "line"))
    return lines.withColumn("line", F.btrim("line", F.lit(BLANKS))).where("line != ''")


def line_sets(docs: DataFrame, t: float) -> DataFrame:
    """(id, key, line_no, node, node2, sig, n, prefix) of each line with words, from (id, key, text)."""
    lines = _split_lines(docs).select("id", "key", "line_no", word_set(F.col("line")).alias("words"))
    words = F.col("words")
    n = F.size(words)
    sig = F.shiftleft(F.least(n, F.lit(MANY)).cast("long"), PARITY).bitwiseOR(_flipped(words, PARITY, lambda x: F.shiftright(x, 8)))
    return lines.select("id", "key", "line_no", F.xxhash64(words).alias("node"), F.xxhash64(F.lit(7), words).alias("node2"), sig.alias("sig"), n.alias("n"), prefixes(words, t).alias("prefix"))


def line_words(lines: DataFrame) -> DataFrame:
    """Puts ``words`` and WIDE in the place of ``line``."""
    sets = lines.withColumn("words", word_set(F.col("line"))).drop("line")
    part = lambda i: lambda x: F.shiftright(x, 14).bitwiseAND(F.lit(1).cast("long")) == i
    return sets.select("*", *[_flipped(F.col("words"), 64, lambda x: F.shiftright(x, 8), part(i)).alias(c) for i, c in enumerate(WIDE)])


def _need(n_a: Column, n_b: Column, t: float) -> Column:
    """Words that two lines at the threshold share at least."""
    return F.ceil((n_a + n_b) * F.lit(t / (1 + t)) - 1e-9)


def _named(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{side}{c}") for c in df.columns])


def postings(nodes: DataFrame, *carried: str) -> DataFrame:
    """(node, columns carried, word): a row for each token of each node."""
    # word comes last, as explode gives it: a self-join then needs no other order of columns on one side, and has one exchange
    return nodes.select("node", *carried, F.explode("prefix").alias("word"))


def _fits(na: Column, nb: Column, differ: Column, t: float) -> Column:
    """Length and parity filters."""
    return (F.least(na, nb) >= F.greatest(na, nb) * t - 1e-9) & (differ <= na + nb - 2 * _need(na, nb, t))


def with_partner(nodes: DataFrame, t: float) -> DataFrame:
    """(node): those that some other node may match by the filters. Both sides of the join are one exchange by token."""
    rows = postings(nodes, "sig")
    na, nb = (F.shiftrightunsigned(c, PARITY) for c in ("a.sig", "b.sig"))
    differ = F.bit_count(F.col("a.sig").bitwiseXOR(F.col("b.sig")).bitwiseAND(F.lit((1 << PARITY) - 1)))
    fits = _fits(na, nb, differ, t) | (F.greatest(na, nb) == MANY)  # or more words than that
    other = (F.col("a.word") == F.col("b.word")) & (F.col("a.node") != F.col("b.node"))
    return rows.alias("a").join(rows.alias("b").hint("merge"), other & fits, "left_semi").select("a.node").distinct()


def reaching(pairs: DataFrame, t: float) -> DataFrame:
    """(node): the later nodes (a) of pairs of sets that reach t."""
    enough = F.size(F.array_intersect("a_words", "b_words")) >= _need(F.size("a_words"), F.size("b_words"), t)
    return pairs.where(enough).select(F.col("a_node").alias("node")).distinct()


def similar_nodes(sets: DataFrame, t: float) -> DataFrame:
    """Of (node, n, prefix, first, words, WIDE) the nodes with an earlier one at or above t."""
    carried, words = ("node", "n", *WIDE, "first"), sets.select("node", "words")
    of_word = Window.partitionBy("word")
    common = postings(sets, *carried[1:]).withColumn("times", F.count("*").over(of_word)).where("times > 1").drop("times")
    still, settled = materialize(common, "common"), []

    def matches(pairs: DataFrame) -> DataFrame:
        """Of pairs of rows a and b the later nodes of those that match."""
        differ = sum(F.bit_count(F.col(f"a.{s}").bitwiseXOR(F.col(f"b.{s}"))) for s in WIDE)
        later = (F.col("a.node") != F.col("b.node")) & (F.col("a.first") > F.col("b.first"))
        ids = pairs.where(later & _fits(F.col("a.n"), F.col("b.n"), differ, t)).select(F.col("a.node").alias("a_node"), F.col("b.node").alias("b_node")).distinct()
        return reaching(ids.join(_named(words, "a_"), "a_node").join(_named(words, "b_"), "b_node"), t)

    rows = still
    for order in (F.col("first"), F.xxhash64("first")):
        pivot = F.first(F.struct(*carried)).over(of_word.orderBy(order, "node"))
        # the pivots are those of all nodes, settled or not
        pairs = rows.select("word", F.struct(*carried).alias("a"), pivot.alias("b"))
        settled.append(materialize(matches(pairs if still is rows else pairs.join(settled[0], F.col("a.node") == F.col("node"), "left_anti")), "settled"))
        still = rows.join(settled[0], "node", "left_anti")
    still = still.join(settled[1], "node", "left_anti")
    rest = matches(still.alias("a").join(rows.alias("b"), F.col("a.word") == F.col("b.word")))
    return rest.unionByName(settled[0]).unionByName(settled[1])


def dedup_lines(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its id, ``text_key``, ``n_rows``, ``n_lines``, ``n_removed`` and ``removed``
    (numbers of the lines that go, from 0, ascending). ``without_lines`` makes the texts.

    Lines without words always stay. Null texts have no lines. Documents are ordered by id (null
    first), then by ``text_key``: documents that share an id, or have none, are judged each on its own.
    Rows that repeat both id and text are one document, ``n_rows`` of them; all but one
    lose their lines. Words are compared by 56 bits of a hash and their length, within two lines at a time; equal
    sets are told by two hashes of these.
    """
    t = threshold
    text = F.col(quoted(text_col)).cast("string")
    base = docs.select(F.col(quoted(id_col)).alias("id"), text_key(text).alias("key"), text.alias("text"))
    found = materialize(line_sets(base, t), "lines")
    place = F.struct("id", "key", "line_no")
    nodes = found.groupBy("node", "node2").agg(F.min(place).alias("first"), F.count("*").alias("times"), F.first("sig").alias("sig"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    nodes = materialize(nodes, "nodes")
    some = materialize(with_partner(nodes, t), "partners")
    near = materialize(nodes.join(some, "node", "left_semi"), "near")
    spots = near.select("node", "node2", "n", "prefix", "first", F.col("first.id").alias("_id"), F.col("first.key").alias("_key"), F.col("first.line_no").alias("_no"))
    here = F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")) & (F.col("line_no") == F.col("_no"))
    fetched = _split_lines(base).join(spots.hint("merge"), here).dropDuplicates(["node", "node2"])  # rows may repeat
    sets = line_words(fetched.select("node", "n", "prefix", "first", "line"))
    sets = materialize(sets, "sets")
    similar = materialize(similar_nodes(sets, t).distinct(), "similar").withColumn("similar", F.lit(True))
    judged = nodes.join(similar, "node", "left").where("times > 1 or similar").select("node", "node2", "first", "times", F.coalesce("similar", F.lit(False)).alias("similar"))
    judged = materialize(judged, "judged")
    discard(near, some, sets)
    every = found.select("id", "key", "line_no", "node", "node2")
    many = found.count()
    heavy, rare = judged.where(F.col("times") * HEAVY > many), judged.where(F.col("times") * HEAVY <= many)
    met = every.join(F.broadcast(heavy), ["node", "node2"]).unionByName(every.join(rare, ["node", "node2"]))
    of_first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key")) & (F.col("line_no") == F.col("first.line_no"))
    gone = met.where(F.col("similar") | ~of_first).groupBy("id", "key").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))
    listed = docs.select(F.col(quoted(id_col)).alias("_id"), text_key(text).alias("text_key"), F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).alias("n_lines"), text.isNull().alias("none"))
    listed = listed.groupBy("_id", "text_key").agg(F.count("*").alias("n_rows"), F.max(F.when(F.col("none"), 0).otherwise(F.col("n_lines"))).cast("long").alias("n_lines"))
    out = listed.join(gone, F.col("_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select(F.col("_id").alias(id_col), "text_key", "n_rows", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def without_lines(docs: DataFrame, judged: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the texts that are left when the lines listed in ``removed`` go; of rows
    that repeat id and text all but one keep only their lines without words."""
    of, key, gone, rows, nth, one = (fresh(x, docs) for x in ("_of", "_key", "_gone", "_rows", "_nth", "_one"))
    touched = judged.where("n_removed > 0 or n_rows > 1")
    touched = touched.select(F.col(quoted(id_col)).alias(of), F.col("text_key").alias(key), F.col("removed").alias(gone), F.col("n_rows").alias(rows))
    text = F.col(quoted(text_col))
    joined = docs.join(touched, F.col(quoted(id_col)).eqNullSafe(F.col(of)) & (text_key(text.cast("string")) == F.col(key)), "left")
    lines = F.split(text, "\n")
    kept = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains(gone, i)), "\n")
    bare = F.array_join(F.filter(lines, lambda line: ~F.regexp_like(line, F.lit(r"[^ \t\r\f\x0B]"))), "\n")
    single = joined.where(F.coalesce(rows, F.lit(1)) == 1).withColumn(text_col, F.when(F.col(gone).isNull(), text).otherwise(kept))
    # numbered and written, so that the numbers hold and no task meets all rows of a document
    again = materialize(joined.where(F.col(rows) > 1).withColumn(nth, F.monotonically_increasing_id()), "twins")
    firsts = again.groupBy(of, key).agg(F.min(nth).alias(one)).select(one)
    again = again.join(firsts, F.col(nth) == F.col(one), "left").withColumn(text_col, F.when(F.col(one).isNotNull(), kept).otherwise(bare)).drop(nth, one)
    return single.unionByName(again).drop(of, key, gone, rows)
