"""Line dedup as an exact set-similarity join, in DataFrame operations only.

A line is the set of its shingles of WIDTH words (fewer words: the line itself is its one token), words
lower-cased.  A line is removed if an earlier line, in the order of (doc_id, line
number), has a Jaccard similarity of 4/5 or more with it.

1. Shingles are counted over all lines, in BUCKETS hashed counters, which give every token a
   rarity; ties are broken by the token, so all lines share one order.
2. Lines of the same words are one class from here on, named by its first line; the others go.
3. Two sets of n tokens can only reach 4/5 if they share one of the n - ceil(4n/5) + 1 rarest.
   Classes emit these prefixes, and tokens that only one class emits drop out at once.
4. Every class is compared with one class that comes first at some of its tokens: that which does so at most
   of them.  That is linear, and settles large groups of near copies, for which all pairs would be the square
   of the group.  Only classes it does not settle go on to all earlier classes at their tokens.
   These meet only where a token may be the rarest that they share: a similar pair has all it shares at that
   token and behind it, so it lies early in both, and classes that share a frequent token further on
   make no pair.
5. Pairs, in 4. those with first classes also a bound by the tokens their prefixes share, are
   verified on whole token sets, from the text of the two lines.

Blank lines have no tokens and stay.  Null text stays null.  Null doc_id comes last in the order.
Rows that repeat doc_id and text are judged alike, as one document.  Empty tables
give no rows.  Results carry the columns of `docs` as they were; extra ones never clash.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window, functions as F

from modgauge.runtime import cut_lineage, ensure_checkpoint_dir

WIDTH = 5
SIMILAR = (4, 5)
BUCKETS = 1 << 16

_NUM, _DEN = SIMILAR
_LAST = (1 << 63) - 1
_KEY = ("doc", "no", "rid")

# A ranked token: its rarity in the upper bits, above these of the token.
_RARE_BITS = 56

# Bytes of a word's code: the hexadecimal digits of its hash.
_CODE = 16


def _words(line: Column) -> Column:
    """The lower-cased words of a line."""
    # Few lines hold other white space than spaces.
    other = line.contains("\t") | line.contains("\x0b") | line.contains("\x0c") | line.contains("\r")
    plain = F.when(other, F.translate(line, "\t\x0b\x0c\r", "    ")).otherwise(line)
    return F.array_remove(F.split(F.lower(plain), " "), "")


def _codes(words: Column) -> Column:
    """The codes of an array of words, one after the other, as bytes.

    A shingle is a stretch of them, so that hashing it takes one step, not one for each of its words.
    """
    # The sign bit is set, so that all codes have as many digits.
    code = F.transform(words, lambda word: F.hex(F.xxhash64(word).bitwiseOR(F.lit(-_LAST - 1))))
    return F.array_join(code, "").cast("binary")


def _starts(codes: Column, width: int) -> Column:
    """Where shingles begin, from 1; fewer words than `width` are one."""
    last = F.greatest(F.octet_length(codes) - _CODE * width, F.lit(0)) + 1
    return F.sequence(F.lit(1), last, F.lit(_CODE))


def _token(codes: Column, start: Column, width: int) -> Column:
    return F.xxhash64(F.substr(codes, start, F.lit(_CODE * width)))


def _set(codes: Column, width: int) -> Column:
    """Distinct hashed shingles of a line's codes."""
    # The codes are bound once, not copied from the row again for every shingle.
    tokens = F.transform(
        F.array(codes), lambda bound: F.transform(_starts(bound, width), lambda start: _token(bound, start, width))
    )
    return F.array_distinct(tokens[0])


def line_tokens(line: Column, width: int = WIDTH) -> Column:
    """Distinct hashed shingles of a line that has words."""
    return _set(_codes(_words(line)), width)


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, rid, no, line): every line with a word."""
    return (
        _keyed(docs)
        .select("doc", "rid", F.posexplode(F.split("text", "\n")).alias("no", "line"))
        .filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    )


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, rid, text) of every row."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("rid"), "text"
    )


def _bucket(token: Column) -> Column:
    return F.shiftrightunsigned(token, 48).cast("int")


def _rarity(lines: DataFrame, width: int) -> Column:
    """A literal array of BUCKETS upper halves of ranked tokens: eight levels for each doubling of the count.

    Higher-order functions take no subquery, so the counters, whose number is fixed,
    pass through the driver.
    """
    codes = lines.select(_codes(_words(F.col("line"))).alias("codes"))
    starts = codes.select("codes", F.explode(_starts(F.col("codes"), width)).alias("start"))
    token = _token(F.col("codes"), F.col("start"), width)
    counts = starts.groupBy(_bucket(token).alias("at")).agg(
        F.least(F.floor(8 * F.log2(F.count("*"))), F.lit(255)).cast("int").alias("level")
    )
    levels = [0] * BUCKETS
    for row in counts.collect():
        levels[row["at"]] = row.level
    upper = ",".join(str((level - 128) << _RARE_BITS) for level in levels)
    return F.split(F.lit(upper), ",").cast("array<bigint>")


def _written(table: DataFrame, name: str) -> DataFrame:
    spark = table.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid4()}"
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def _least(n: Column) -> Column:
    """Tokens that a set of n shares at least with a similar one."""
    return F.floor((n * _NUM + _DEN - 1) / _DEN).cast("int")


def _line_table(docs: DataFrame, width: int) -> DataFrame:
    """(k1, k2, doc, no, rid, n, prefix) of every line with a word, written once.

    (k1, k2) is a 128-bit hash of the codes of the words, prefix holds the rarest of the n tokens, ranked.
    """
    lines = _lines(docs)
    rarity = _rarity(lines, width)
    codes = lines.select(*_KEY, _codes(_words(F.col("line"))).alias("codes"))
    sets = codes.select(*_KEY, *_word_key(F.col("codes")), _set(F.col("codes"), width).alias("tokens"))
    lower = F.lit((1 << _RARE_BITS) - 1)
    # There is a rarity for every bucket; arrays that cannot hold nulls are sorted faster.
    rare = lambda t: F.coalesce(F.get(rarity, _bucket(t)), F.lit(0).cast("bigint"))
    ranked = F.sort_array(F.transform("tokens", lambda t: rare(t).bitwiseOR(t.bitwiseAND(lower))))
    n = F.size("tokens")
    prefix = F.slice(ranked, F.lit(1), n - _least(n) + 1).alias("prefix")
    return _written(sets.select("k1", "k2", *_KEY, n.alias("n"), prefix), "lines")


def _classes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k1, k2, lines, doc, no, rid, n, prefix) of every class of the line table, and of those of several lines.

    `lines` counts the class, the rest is its first line's.  Only rows that may be of the same words as others are grouped.
    """
    equal = lines.groupBy("k1", "k2").count().filter("count > 1")
    may = _may_hold(equal, "k1", "k2", words=4 * BUCKETS)
    first = F.min(F.struct(*_KEY, "n", "prefix")).alias("f")
    grouped = lines.filter(may).groupBy("k1", "k2").agg(first, F.count("*").alias("lines"))
    grouped = _written(grouped.select("k1", "k2", "lines", "f.*"), "classes")
    alone = lines.filter(~may).withColumn("lines", F.lit(1).cast("bigint"))
    return alone.select(grouped.columns).unionByName(grouped), grouped.filter("lines > 1")


def _class_table(docs: DataFrame, width: int) -> DataFrame:
    """(k1, k2, lines, doc, no, rid, n, prefix) of every class of lines."""
    return _classes(_line_table(docs, width))[0]


def _word_key(codes: Column) -> list[Column]:
    return [F.xxhash64(codes).alias("k1"), F.xxhash64(F.lit(1), codes).alias("k2")]


def _order(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c) for c in _KEY])


def _first_met(nx: Column, px: Column, ny: Column, py: Column) -> Column:
    """Length and positional filter on two postings that may be the rarest token of a similar pair.

    All that the pair shares lies at that token and behind it, so it must lie early enough in both.
    """
    return F.least(nx - px, ny - py) * (_NUM + _DEN) >= (nx + ny) * _NUM


def _close(nx: Column, px: Column, ny: Column, py: Column) -> Column:
    """Length and positional filter on two postings of one token."""
    most = F.least(px, py) + 1 + F.least(nx - px, ny - py) - 1
    return (
        (F.least(nx, ny) * _DEN >= F.greatest(nx, ny) * _NUM)
        & (most * (_NUM + _DEN) >= (nx + ny) * _NUM)
    )


def _pairs(meetings: DataFrame) -> DataFrame:
    """(x_doc, ..., y_doc, ..., shared) of rows that give a token two classes share and their sizes.

    Common tokens outside one of the prefixes number no more than lie behind the prefix of that class.
    """
    sides = [f"{a}_{c}" for a in "xy" for c in _KEY]
    nx, ny = F.col("x_n"), F.col("y_n")
    pairs = meetings.groupBy(*sides, "x_n", "y_n").agg(F.count("*").alias("shared"))
    most = F.col("shared") + _least(F.greatest(nx, ny)) - 1
    return pairs.filter(most * (_NUM + _DEN) >= (nx + ny) * _NUM).select(*sides, "shared")


def _verified(pairs: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(doc, no, rid) of the lines x of pairs whose sets are similar, written once."""
    pairs = _written(pairs, "pairs")
    needed = pairs.select(*[F.col(f"x_{c}").alias(c) for c in _KEY]).unionByName(
        pairs.select(*[F.col(f"y_{c}").alias(c) for c in _KEY])
    )
    texts = _keyed(docs).filter(_may_hold(needed, "doc", "rid"))
    lines = texts.select("doc", "rid", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    # Rows that repeat doc_id and text repeat their lines.
    lines = lines.filter(_may_hold(needed, *_KEY)).select(*_KEY, "line").dropDuplicates(list(_KEY))
    x = lines.toDF(*[f"x_{c}" for c in _KEY], "x_line")
    y = lines.toDF(*[f"y_{c}" for c in _KEY], "y_line")
    found = pairs.join(x, [f"x_{c}" for c in _KEY]).join(y, [f"y_{c}" for c in _KEY])
    found = found.select(
        *[F.col(f"x_{c}").alias(c) for c in _KEY],
        *[line_tokens(F.col(f"{a}_line"), width).alias(f"{a}_tokens") for a in "xy"],
    )
    both = F.size(F.array_intersect("x_tokens", "y_tokens"))
    total = F.size("x_tokens") + F.size("y_tokens")
    similar = found.filter(both * (_NUM + _DEN) >= total * _NUM)
    return _written(similar.select(*_KEY).distinct(), "matched")


def _may_hold(keys: DataFrame, *names: str, words: int = BUCKETS) -> Column:
    """A condition that rows with these keys meet, and few others: a bit set of `words` longs.

    It only spares a shuffle rows that an exact join would drop; when there are too many keys it
    drops fewer.
    """
    bit = f"pmod(xxhash64({', '.join(names)}), {words * 64})"
    at, mask = F.expr(f"{bit} DIV 64"), F.expr(f"shiftleft(1L, CAST({bit} % 64 AS INT))")
    bits = keys.select(at.alias("at"), mask.alias("m")).groupBy("at").agg(F.bit_or("m").alias("n"))
    every = keys.sparkSession.range(words).select(F.col("id").alias("at"), F.lit(0).cast("bigint").alias("n"))
    rows = bits.unionByName(every).groupBy("at").agg(F.bit_or("n").alias("n"))
    sets = F.sort_array(F.collect_list(F.struct("at", "n"))).n
    word = cut_lineage(rows.agg(sets.alias("n")))[0].scalar()
    return word[at.cast("int")].bitwiseAND(mask) != 0


def _postings(classes: DataFrame) -> DataFrame:
    """(token, doc, no, rid, n, pos, y_doc, ..., y_pos), written once: classes at the tokens that several
    emit, and the first class there.
    """
    postings = classes.select(*_KEY, "n", F.posexplode("prefix").alias("pos", "token"))
    shared = postings.groupBy("token").count().filter("count > 1").select("token")
    shared = _written(shared, "shared")
    postings = postings.filter(_may_hold(shared, "token", words=4 * BUCKETS)).join(shared, "token", "left_semi")
    first = F.first(F.struct(*_KEY, "n", "pos")).over(Window.partitionBy("token").orderBy(*_KEY))
    postings = postings.withColumn("first", first)
    leader = [F.col(f"first.{c}").alias(f"y_{c}") for c in (*_KEY, "n", "pos")]
    return _written(postings.select("token", *_KEY, "n", "pos", *leader), "postings")


def _meetings(postings: DataFrame, settled: DataFrame) -> DataFrame:
    """(x_doc, ..., y_doc, ...) of classes x that are not settled and earlier classes y, where a token may be the
    rarest that they share.
    """
    all_ = postings.select("token", *_KEY, "n", "pos")
    open_ = all_.join(settled, list(_KEY), "left_anti").select(all_.columns)
    open_, all_ = (rows.toDF("token", *[f"{a}_{c}" for c in all_.columns[1:]]) for a, rows in (("x", open_), ("y", all_)))
    ends = [F.col(c) for c in ("x_n", "x_pos", "y_n", "y_pos")]
    meet = open_.join(all_, "token").filter((_order("y_") < _order("x_")) & _first_met(*ends))
    return meet.select(*[f"{a}_{c}" for a in "xy" for c in _KEY])


def removed_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc, rid, no) of every line that has an earlier match."""
    lines = _line_table(docs, width)
    classes, several = _classes(lines)
    postings = _postings(classes)
    x = [F.col(c).alias(f"x_{c}") for c in (*_KEY, "n")]
    y = [f"y_{c}" for c in (*_KEY, "n")]
    ends = [F.col(c) for c in ("n", "pos", "y_n", "y_pos")]
    pairs = _pairs(postings.filter((_order("y_") < _order()) & _close(*ends)).select(*x, *y))
    most = F.struct(-F.col("shared"), *[f"y_{c}" for c in _KEY])
    best = pairs.groupBy(*[f"x_{c}" for c in _KEY]).agg(F.min(most).alias("y"))
    best = best.select(*[f"x_{c}" for c in _KEY], *[f"y.y_{c}" for c in _KEY])
    settled = _verified(best, docs, width)

    pairs = _meetings(postings, settled).distinct()
    matched = settled.unionByName(_verified(pairs, docs, width))

    # All lines of a class but its first go, and the first of a matched class.
    several = several.select("k1", "k2", F.struct(*_KEY).alias("first"))
    keys = lines.select("k1", "k2", *_KEY)
    later = keys.filter(_may_hold(several, "k1", "k2", words=4 * BUCKETS)).join(several, ["k1", "k2"])
    later = later.filter(F.struct(*_KEY) != F.col("first")).select(*_KEY)
    return later.unionByName(matched).select("doc", "rid", "no").distinct()


def _by_document(docs: DataFrame, width: int) -> DataFrame:
    gone = removed_lines(docs, width).groupBy("doc", "rid")
    return gone.agg(F.array_sort(F.collect_list("no")).alias("_gone"))


def _marked(docs: DataFrame, width: int, columns: list[Column]) -> DataFrame:
    """`columns`, and _gone: the numbers of the lines to remove, for every row."""
    keyed = docs.select(
        *columns,
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("_doc"),
        F.xxhash64("text").alias("_rid"),
    )
    gone = _by_document(docs, width)
    none = F.array().cast("array<int>")
    return keyed.join(
        gone, (F.col("_doc") == F.col("doc")) & (F.col("_rid") == F.col("rid")), "left"
    ).withColumn("_gone", F.coalesce("_gone", none)).drop("_doc", "_rid", "doc", "rid")


def report(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) of every row; `removed` lists line numbers from 0."""
    lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("bigint").alias("n_lines")
    marked = _marked(docs, width, [F.col("doc_id"), F.when(F.col("text").isNull(), 0).otherwise(lines).alias("n_lines")])
    return marked.select(
        "doc_id",
        F.col("n_lines").cast("bigint").alias("n_lines"),
        F.size("_gone").cast("bigint").alias("n_removed"),
        F.array_join(F.transform("_gone", lambda i: i.cast("string")), ",").alias("removed"),
    )


def dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """`docs` with later matches cut out of their texts, and n_chars, if any, set anew."""
    lost = {c: c for c in docs.columns}
    named = [F.col(c).alias(f"_own_{i}") for i, c in enumerate(lost)]
    marked = _marked(docs, width, named)
    at = docs.columns.index("text")
    lines = F.split(f"_own_{at}", "\n")
    kept = F.array_join(
        F.filter(
            F.zip_with(lines, F.sequence(F.lit(0), F.size(lines) - 1), lambda l, i: F.struct(l.alias("l"), i.alias("i"))),
            lambda x: ~F.array_contains("_gone", x.i),
        ).l,
        "\n",
    )
    text = F.when(F.size("_gone") > 0, kept).otherwise(F.col(f"_own_{at}"))
    marked = marked.withColumn(f"_own_{at}", text)
    columns = [
        F.char_length(f"_own_{at}").cast(docs.schema[c].dataType).alias(c)
        if c == "n_chars"
        else F.col(f"_own_{i}").alias(c)
        for i, c in enumerate(docs.columns)
    ]
    return marked.select(*columns)
