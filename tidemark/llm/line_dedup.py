"""Removal of repeated lines by an exact set-similarity join (operator 5), with DataFrame functions alone.

Lines are cut at line feeds. A line's tokens are its distinct 5-word shingles (words between spaces, in lower case); a
line of fewer words has its whole sequence as one token, and a line without words has none and always stays. In the
order of doc_id and position, a line is removed if an earlier line has a Jaccard similarity of at least 3/4 with it.

Lines of equal text: all but the first go. Their counts come from hashes that are combined before they are shuffled;
the few texts that make up more than 1 / HOT_SHARE of all lines are known to every task (there can be no more than
HOT_SHARE of them), which drops their copies without a shuffle. Only first lines are joined: whatever matches a copy
matches the first line of its text. Which lines are copies, and later which lines a pair asks for, every task knows by
bitmaps of hashed places; the few lines that a bitmap wrongly names are told apart by an exact join.

The join: tokens are ordered by rarity (how many tokens of all lines fall into the same of SLOTS hashed slots, by powers
of two; then by hash), and a line of n tokens is filed under its first n/4 + 1. Lines that match share one of those. The
length filter asks for sizes within 3/4 of each other; the positional filter for enough tokens after the shared one. In
each file the first line is compared with all others, and then each line that is still there with those before it.
On their way to the files, place, size and rank of a line are one number wherever they fit. A pair is first compared by sketches, the parities of its
tokens on 64 to 256 bits: two lines differ in at least as many tokens as their sketches in bits. Pairs that are not told
apart are compared by their tokens, counting the shared ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _common as C

WIDTH, NUM, DEN = 5, 3, 4
SLOTS, HOT_SHARE = 1 << 16, 20_000
#: Bitmaps have PER_MARK places for each mark, 2 ** MOST_BITS (16 MB) at most, and 2 ** ROW_BITS of them in a row.
PER_MARK, MOST_BITS, ROW_BITS = 8, 27, 10
_LOW = (1 << 58) - 1
#: Bits of doc_id, pos, n and i in one number.
_DOC, _POS, _N, _I = 28, 13, 12, 10


def _with(value: Column, use) -> Column:
    """use(value), where value is evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _words(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), " "), "")


def _hashes(line: Column) -> Column:
    """Hashes of the shingles of a line, in their places."""

    def of(w: Column) -> Column:
        runs = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, WIDTH)]))
        return F.when(F.size(w) >= WIDTH, F.slice(runs, F.lit(1), F.greatest(F.size(w) - (WIDTH - 1), F.lit(0)))).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))

    return _with(_words(line), of)


def _each_hash(lines: DataFrame) -> DataFrame:
    """(h): the same hashes, a row each. Without a function of each element, Spark compiles all of it."""
    names = [f"w{j}" for j in range(WIDTH)]
    words = lines.select(_words(F.col("line")).alias("w"))
    runs = words.select("w", *[F.slice("w", F.lit(j + 1), F.greatest(F.size("w") - (WIDTH - 1), F.lit(0))).alias(c) for j, c in enumerate(names)])
    short = F.array(F.struct(F.array_join("w", " ").alias("w0"), *[F.lit(None).cast("string").alias(c) for c in names[1:]]))  # nulls leave a hash as it is
    shingle = F.explode_outer(F.when(F.size("w") >= WIDTH, F.arrays_zip(*names)).otherwise(short))
    return runs.select(shingle.alias("x")).select(F.xxhash64(*[F.col(f"x.{c}") for c in names]).alias("h"))


def _tokens(line: Column, classes: str) -> Column:
    """Distinct tokens, rarest first: 5 bits of rarity above 58 bits of hash. classes: the rarity of each slot."""
    table = F.split(F.lit(classes), ",").cast("array<bigint>")
    key = lambda h: F.shiftleft(F.get(table, h.bitwiseAND(SLOTS - 1).cast("int")), 58).bitwiseOR(h.bitwiseAND(_LOW))
    return F.sort_array(F.array_distinct(F.transform(_hashes(line), key)))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line) of lines with a word. They have tokens, so no filter may ask for those: Spark would move it down
    and build all tokens twice (``explode`` brings such a filter, ``explode_outer`` does not)."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.trim("line") != "")


def _classes(docs: DataFrame) -> str:
    """The power of two of the tokens of each slot of hashes, joined by commas. SLOTS rows reach the driver."""
    rows = _each_hash(_lines(docs)).groupBy(F.col("h").bitwiseAND(SLOTS - 1).alias("slot")).count().collect()
    out = [0] * SLOTS
    for slot, n in rows:
        out[slot] = min(31, int(math.log2(n)))
    return ",".join(map(str, out))


def _needed(n: Column, m: Column) -> Column:
    """Least shared tokens of matching sets of n and m: (n + m) * 3 / 7, rounded up, as integers."""
    return F.floor(((n + m) * NUM + (DEN + NUM - 1)) / (DEN + NUM))


def _possible(n: Column, i: Column, m: Column, j: Column) -> Column:
    """The length and the positional filter."""
    return (n * DEN >= m * NUM) & (m * DEN >= n * NUM) & (F.least(n - i, m - j) >= _needed(n, m))


class _Marks:
    """The places (doc_id, pos) of ``rows`` as bits at their hashes, in a table that every task gets."""

    def __init__(self, ws: C.Workspace, rows: DataFrame, name: str):
        self.bits = min(MOST_BITS, max(ROW_BITS, (PER_MARK * rows.count()).bit_length()))
        piece, word, bit = self._at()
        word_of = [F.coalesce(F.bit_or(F.when(F.col("word") == j, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit")))), F.lit(0).cast("long")) for j in range((1 << ROW_BITS) // 64)]
        self.table = ws.save(rows.select(piece.alias("piece"), word.alias("word"), bit.alias("bit")).groupBy("piece").agg(F.array(*word_of).alias("words")), name)

    def _at(self) -> tuple[Column, Column, Column]:
        place = F.shiftrightunsigned(F.xxhash64("doc_id", "pos"), 64 - self.bits)
        return F.shiftright(place, ROW_BITS), F.shiftright(place, 6).bitwiseAND((1 << ROW_BITS) // 64 - 1).cast("int"), place.bitwiseAND(63).cast("int")

    def split(self, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``lines`` that are marked, among them all of the marked places, and the others."""
        piece, word, bit = self._at()
        found = lines.withColumn("piece", piece).join(F.broadcast(self.table), "piece", "left")
        hit = F.coalesce(F.call_function("shiftright", F.get("words", word), bit).bitwiseAND(1) == 1, F.lit(False))
        return found.where(hit).select(*lines.columns), found.where(~hit).select(*lines.columns)


def _keyed(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"k1": F.xxhash64("line"), "k2": F.xxhash64("line", F.lit(1))})


def _hot(lines: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """Lines with (d0, p0), the first place of their text, if it is one of the at most HOT_SHARE frequent ones."""
    hot = F.broadcast(counts.where(F.col("n") >= max(50, total // HOT_SHARE + 1)).select("k1", "k2", F.col("first.doc_id").alias("d0"), F.col("first.pos").alias("p0")))
    return _keyed(lines).join(hot, ["k1", "k2"], "left").withColumn("hot_copy", F.coalesce((F.col("doc_id") != F.col("d0")) | (F.col("pos") != F.col("p0")), F.lit(False)))


def _same(ws: C.Workspace, docs: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(doc_id, pos, k1, k2, hot) of lines whose text is that of an earlier one."""
    rows = _hot(_lines(docs), counts, total)
    cold = rows.where("d0 is null").select("k1", "k2", "doc_id", "pos").join(counts.where("n > 1").select("k1", "k2", "first"), ["k1", "k2"]).where((F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.pos") != F.col("pos")))
    own = ["doc_id", "pos", "k1", "k2"]
    return ws.save(rows.where("hot_copy").select(*own, F.lit(True).alias("hot")).union(cold.select(*own, F.lit(False).alias("hot"))), "same")


def _firsts(ws: C.Workspace, docs: DataFrame, counts: DataFrame, total: int, same: DataFrame) -> DataFrame:
    """(doc_id, pos, line) of all lines but those of ``same``."""
    marked, others = _Marks(ws, same, "same-marks").split(_lines(docs))
    left = _hot(marked, counts, total).where("not hot_copy").join(same.where("not hot").drop("hot"), ["doc_id", "pos", "k1", "k2"], "left_anti")
    return others.unionByName(left.select("doc_id", "pos", "line"))


def _words_of(n: Column) -> Column:
    """Words of 64 bits in the sketch of a line of n tokens."""
    return F.when(n <= 40, 1).when(n <= 90, 2).otherwise(4)


def _sketch(t: Column) -> Column:
    """Four longs, the last of which are 0 for short lines: at each bit, whether an odd number of tokens fall on it."""

    n, none = F.size(t), F.lit(0).cast("long")
    flip = lambda acc, x: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int")))

    def word(j: int) -> Column:
        mine = lambda words: F.aggregate(F.filter(t, lambda x: F.shiftright(x, 6).bitwiseAND(words - 1) == j) if words > 1 else t, none, flip)
        return F.when(n <= 40, none if j else mine(1)).when(n <= 90, none if j > 1 else mine(2)).otherwise(mine(4))

    return F.named_struct(*(x for j in range(4) for x in (F.lit(f"s{j}"), word(j))))


def _apart(a: Column, b: Column, n: Column, m: Column) -> Column:
    """In how many tokens two lines differ at least. A token that only one of them has flips one bit; the wider sketch is
    folded to the width of the other."""
    x = [a[f"s{j}"].bitwiseXOR(b[f"s{j}"]) for j in range(4)]
    one = F.bit_count(x[0].bitwiseXOR(x[1]).bitwiseXOR(x[2]).bitwiseXOR(x[3]))
    two = F.bit_count(x[0].bitwiseXOR(x[2])) + F.bit_count(x[1].bitwiseXOR(x[3]))
    four = F.bit_count(x[0]) + F.bit_count(x[1]) + F.bit_count(x[2]) + F.bit_count(x[3])
    least = F.least(_words_of(n), _words_of(m))
    return F.when(least == 1, one).when(least == 2, two).otherwise(four)


def _packed(filed: DataFrame) -> DataFrame:
    """doc_id, pos, n and i of ``filed`` in one number (``packed``), or else all four in ``wide``."""
    small = F.col("doc_id").between(0, (1 << _DOC) - 1) & (F.col("pos") < 1 << _POS) & (F.col("n") < 1 << _N)  # i is at most n / 4
    packed = F.lit(0).cast("long")
    for name, bits in (("doc_id", _DOC), ("pos", _POS), ("n", _N), ("i", _I)):
        packed = F.shiftleft(packed, bits).bitwiseOR(F.col(name).cast("long"))
    own = [c for c in filed.columns if c not in ("doc_id", "pos", "n", "i")]
    return filed.select(*own, F.when(small, packed).alias("packed"), F.when(~small, F.struct("doc_id", "pos", "n", "i")).alias("wide"))


def _parts(packed: Column) -> list[Column]:
    """The numbers in ``packed``, as _packed names them."""
    out, at = [], 0
    for name, bits, kind in (("i", _I, "int"), ("n", _N, "int"), ("pos", _POS, "int"), ("doc_id", _DOC, "long")):
        out.append(F.shiftright(packed, at).bitwiseAND((1 << bits) - 1).cast(kind).alias(name))
        at += bits
    return out[::-1]


def _unpacked(rows: DataFrame) -> DataFrame:
    parts = [F.coalesce(F.col(f"wide.{name}"), x).alias(name) for name, x in zip(("doc_id", "pos", "n", "i"), _parts(F.col("packed")), strict=True)]
    return rows.select(*[c for c in rows.columns if c not in ("packed", "wide")], *parts)


def _files(ws: C.Workspace, lines: DataFrame, classes: str) -> DataFrame:
    """(token, doc_id, pos, n, i, lead, later): lines under each of their first tokens that another line is filed under
    too, and under their very first token in any case. The lead is the first of a file's lines that have a packed number,
    null without such; ``later``: whether this is another line of a file of several. Most files are of one line, so they
    are counted and their lines looked up, and nothing is sorted."""
    filed = lines.select("doc_id", "pos", _tokens(F.col("line"), classes).alias("t"))
    filed = filed.select("doc_id", "pos", F.size("t").alias("n"), F.posexplode_outer(F.slice("t", F.lit(1), (F.size("t") / DEN).cast("int") + 1)).alias("i", "token"))
    # with this filter, which the join asks of one side alone, and all columns in the count, both sides read one shuffle
    filed = _packed(filed).where("token is not null").repartition("token")
    several = filed.groupBy("token").agg((F.count("packed") + F.count("wide")).alias("lines"), F.min("packed").alias("first")).where("lines > 1")
    found = filed.join(several.hint("shuffle_hash"), "token", "left").withColumns({"lead": F.when(F.col("first").isNotNull(), F.struct(*_parts(F.col("first")))), "later": F.col("lines").isNotNull() & F.coalesce(F.col("packed") != F.col("first"), F.lit(True))})
    return ws.save(_unpacked(found).where("lines is not null or i = 0").drop("lines", "first"), "files")


def _close(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (da, pa, db, pb) whose sketches do not tell them apart."""
    a, b = (texts.select(F.col("doc_id").alias(f"d{x}"), F.col("pos").alias(f"p{x}"), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    near = _apart(F.col("sa"), F.col("sb"), F.col("na"), F.col("nb")) * (DEN + NUM) <= (F.col("na") + F.col("nb")) * (DEN - NUM)
    return pairs.join(a, ["da", "pa"]).join(b, ["db", "pb"]).where(near).select("da", "pa", "db", "pb")


def _matches(ws: C.Workspace, docs: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """(doc_id, pos) of the later lines of pairs that match, by their sketches and then by their shared tokens."""
    asked = pairs.select(F.explode(F.array(F.struct(F.col("da").alias("doc_id"), F.col("pa").alias("pos")), F.struct(F.col("db").alias("doc_id"), F.col("pb").alias("pos")))).alias("x")).select("x.*")
    wanted = ws.save(asked.distinct(), f"{name}-wanted")
    marked, _ = _Marks(ws, wanted, f"{name}-marks").split(docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")))
    rows = marked.join(wanted, ["doc_id", "pos"]).select("doc_id", "pos", F.array_distinct(_hashes(F.col("line"))).alias("t"))
    texts = ws.save(rows.select("doc_id", "pos", "t", F.size("t").alias("n"), _sketch(F.col("t")).alias("sketch")), f"{name}-tokens")
    C.free_shuffles(ws.spark)
    pairs = ws.save(_close(pairs, texts), f"{name}-close")
    a, b = (texts.select(F.col("doc_id").alias(f"d{x}"), F.col("pos").alias(f"p{x}"), F.col("t").alias(f"t{x}")) for x in "ab")
    shared = F.size(F.array_intersect("ta", "tb"))
    return ws.save(pairs.join(a, ["da", "pa"]).join(b, ["db", "pb"]).where(shared * DEN >= (F.size("ta") + F.size("tb") - shared) * NUM).select(F.col("db").alias("doc_id"), F.col("pb").alias("pos")).distinct(), name)


def removed_lines(docs: DataFrame, name: str = "lines") -> DataFrame:
    """(doc_id, pos) of every line to remove, of documents (doc_id long, text) without null doc_ids or texts."""
    spark = docs.sparkSession
    ws = C.Workspace(spark, name)
    counts = ws.save(_keyed(_lines(docs)).groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first")), "keys")
    total = counts.agg(F.sum("n")).first()[0] or 0
    same = _same(ws, docs, counts, total)
    C.free_shuffles(spark)
    files = _files(ws, _firsts(ws, docs, counts, total, same), _classes(docs))
    ws.drop("keys", "same-marks")
    same = same.select("doc_id", "pos")

    others = files.where("later")
    one, other = F.struct("lead.doc_id", "lead.pos"), F.struct("doc_id", "pos")
    stars = others.where(_possible(F.col("lead.n"), F.col("lead.i"), F.col("n"), F.col("i"))).select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b"))
    stars = ws.save(stars.select(F.col("a.doc_id").alias("da"), F.col("a.pos").alias("pa"), F.col("b.doc_id").alias("db"), F.col("b.pos").alias("pb")).distinct(), "stars")
    C.free_shuffles(spark)
    gone = _matches(ws, docs, stars, "near")
    ws.drop("near-close", "near-wanted", "near-marks", "near-tokens")
    # the lead of a file is compared with all others, so a pair that is left is of two others
    a = others.select("token", F.col("doc_id").alias("da"), F.col("pos").alias("pa"), F.col("n").alias("na"), F.col("i").alias("ia"))
    b = others.join(gone, ["doc_id", "pos"], "left_anti").select("token", F.col("doc_id").alias("db"), F.col("pos").alias("pb"), F.col("n").alias("nb"), F.col("i").alias("ib"))
    rest = b.join(a, "token").where("da < db or (da = db and pa < pb)").where(_possible(F.col("na"), F.col("ia"), F.col("nb"), F.col("ib"))).select("da", "pa", "db", "pb").distinct()
    rest = ws.save(rest.join(stars, ["da", "pa", "db", "pb"], "left_anti"), "rest")
    C.free_shuffles(spark)
    out = ws.save(same.union(gone).union(_matches(ws, docs, rest, "far")).distinct(), "removed")
    ws.drop("same", "files", "stars", "near", "rest", "far-close", "far-wanted", "far-marks", "far-tokens", "far")
    return out


def dedup_lines(docs: DataFrame, name: str = "lines", count: str | None = None) -> DataFrame:
    """``docs`` with their repeated lines taken out of text; ``count`` names a column for the number of lines that went.

    A null text stays null and an empty one empty. Rows with a null doc_id stay as they are. Rows that share a doc_id
    are one document's copies: a line that goes from one place of it goes from that place of each. Blank lines stay.
    Other columns are left alone; one that is named like ``count`` gives way to it.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    places, key = C.free(docs.columns, "places", "of_doc")
    lists = removed_lines(plain, name).groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("pos").alias(places))  # lines of one document
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(places, i)), "\n")
    gone = F.when(F.col(places).isNull(), 0).otherwise(F.size(places)).cast("long")
    others = [c for c in docs.columns if not count or c.lower() != count.lower()]
    out = docs.join(lists, F.col("doc_id").cast("long") == F.col(key), "left").withColumn("text", F.when(F.col(places).isNull(), F.col("text")).otherwise(kept))
    return out.select(*(F.col(f"`{c}`") for c in others), *([gone.alias(count)] if count else []))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_kept_chars, kept_sha256) for each document; n_lines is 1 without a line feed."""
    docs = C.documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = dedup_lines(docs.withColumn("n_lines", F.size(F.split("text", "\n")).cast("long")), "op5", "n_removed")
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_kept_chars"), F.sha2("text", 256).alias("kept_sha256"))
