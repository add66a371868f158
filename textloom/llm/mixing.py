"""Mixing sources to target weights (operator 3), DataFrame functions only.

Every row gets a hash-random key; its leading digits are a range of the key, so ranges within
a source hold about equally many rows however large the source is. Prefix sums of sizes are
distributed: a small sum per (source, range) gives each range its offset, and a window
inside the range adds the rest. A source's budget is cut at exactly that prefix, after as
many whole epochs as fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import WS, free_name, word_count, written

#: Hexadecimal digits of the random key that name a range within a source, at least, and the
#: rows of a range at most, on average: more rows take more digits. Results don't depend on it.
RANGE_DIGITS, RANGE_ROWS = 3, 20_000
#: Weights of the sources in code point order (null last), repeating.
WEIGHTS = (5, 2, 1)
#: What the mix holds, as a share of all sizes, and the most epochs of a source.
SHARE, MOST_EPOCHS = 1.5, 2


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = MOST_EPOCHS) -> DataFrame:
    """Budget per source: `sizes` has none (source is null), name, source_size; adds target.

    Sources share `share` of all sizes by weight; none gets more than `epochs` times its
    size, and the excess goes to the others by weight. Filling the sources in order of
    size per weight gives the limit of that resharing in one pass. There is a row for each source
    here, so the ordering windows work on that small table.
    """
    nth = F.row_number().over(Window.orderBy("none", "name"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((nth - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(epochs))
    ranked = ranked.withColumn("fill", F.col("most") / F.col("weight"))
    upward = Window.orderBy("fill", "none", "name")
    total = F.sum("source_size").over(Window.partitionBy()) * float(share)
    left = total - F.coalesce(F.sum("most").over(upward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = left / F.sum("weight").over(upward.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", level).withColumn("full", F.col("fill") <= F.col("level"))
    # The level of the first source that isn't full holds for all that aren't.
    first = F.min(F.when(~F.col("full"), F.struct("fill", "none", "name", "level"))).over(Window.partitionBy())
    target = F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * first["level"])
    return ranked.select("none", "name", "source_size", target.alias("target"))


def range_digits(rows: int) -> int:
    """Digits of a range's name, so many that `rows` of one source make ranges of RANGE_ROWS."""
    digits = RANGE_DIGITS
    while rows > 16**digits * RANGE_ROWS:
        digits += 1
    return digits


def assign(docs: DataFrame, *, key: str, source: str, size: str, weights=WEIGHTS, share: float = SHARE, epochs: int = MOST_EPOCHS, seed: int = 0) -> DataFrame:
    """`docs` with source_size, target and taken (size units that the mix takes) added.

    Reruns agree: the order is that of the MD5 of `seed` and `key`, ties by `key`, then `size`.
    Rows with a null key are ordered by a hash of all their columns instead, so that many of
    them spread over the ranges. A null source is a source of its own; rows of size 0 take 0.
    The added columns replace columns of those names.
    """
    docs = docs.drop("source_size", "target", "taken")
    none, name, rand, part = (free_name(docs, x) for x in ("none", "name", "rand", "range"))
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    order = F.when(F.col(f"`{key}`").isNull(), F.xxhash64(F.lit("null"), *hashed).cast("string")).otherwise(F.col(f"`{key}`").cast("string"))
    keyed = docs.withColumns({
        none: F.col(f"`{source}`").isNull(),
        name: F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")),
        rand: F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), order)), 1, 16),
    }).withColumn(part, F.substring(rand, 1, range_digits(docs.count())))
    sums = written(keyed.groupBy(F.col(none).alias("none"), F.col(name).alias("name"), F.col(part).alias("range")).agg(F.sum(size).alias("range_size")), "range-sums")
    budget = targets(sums.groupBy("none", "name").agg(F.sum("range_size").alias("source_size")), weights, share, epochs)
    upward = Window.partitionBy("none", "name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("range_size").over(upward), F.lit(0))
    plan = sums.withColumn("offset", offset).join(budget, ["none", "name"])
    plan = plan.select(F.col("none").alias(none), F.col("name").alias(name), F.col("range").alias(part), *[F.col(c).alias(f"{rand}_{c}") for c in ("offset", "source_size", "target")])
    inside = Window.partitionBy(none, name, part).orderBy(rand, F.col(f"`{key}`"), F.col(size)).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col(f"{rand}_offset") + F.coalesce(F.sum(size).over(inside), F.lit(0))
    whole = F.when(F.col(f"{rand}_source_size") > 0, F.floor(F.col(f"{rand}_target") / F.col(f"{rand}_source_size"))).otherwise(F.lit(0))
    rest = F.round(F.col(f"{rand}_target") - F.col(f"{rand}_whole") * F.col(f"{rand}_source_size")).cast("long")
    taken = F.col(f"{rand}_whole") * F.col(size) + F.greatest(F.lit(0), F.least(F.col(size), F.col(f"{rand}_rest") - F.col(f"{rand}_before")))
    mixed = (
        keyed.join(plan, [none, name, part])
        .withColumn(f"{rand}_before", before)
        .withColumn(f"{rand}_whole", whole.cast("long"))
        .withColumn(f"{rand}_rest", rest)
    )
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"{rand}_source_size").cast("long").alias("source_size"), F.col(f"{rand}_target").cast("double").alias("target"), taken.cast("long").alias("taken"))


def sizes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, source and size (words of the whole text; null: 0) of every row."""
    return docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"))


def first_words(text: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"[^{WS}]+"), F.lit(0)), 1, n.cast("int")), " ")


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", length: str = "n_chars", **how) -> DataFrame:
    """The mix itself: rows of `docs`, once for every epoch that takes them.

    The row at which a source's budget ends gives only as many of its words as are left
    (then `length`, if there, is counted anew). Rows without words have nothing to take and
    are not in the mix.
    """
    n, i = free_name(docs, "size"), free_name(docs, "epoch")
    sized = docs.withColumn(n, word_count(F.col(f"`{text}`")))
    mixed = assign(sized.withColumns({f"{n}{c}": F.col(f"`{c}`") for c in ("source_size", "target", "taken") if c in docs.columns}), key=key, source=source, size=n, **how)
    copies = F.expr(f"sequence(1, cast(ceil(taken / {n}) as int))")
    mixed = mixed.where("taken > 0").withColumn(i, F.explode(copies))
    left = F.col("taken") - (F.col(i) - 1) * F.col(n)
    cut = left < F.col(n)
    short = F.when(cut, first_words(F.col(f"`{text}`"), left)).otherwise(F.col(f"`{text}`"))
    out = {c: F.col(f"`{n}{c}`" if c in ("source_size", "target", "taken") else f"`{c}`") for c in docs.columns}
    out[text] = short
    if length in out:
        out[length] = F.when(cut, F.length(short).cast("long")).otherwise(out[length])
    return mixed.select(*[v.alias(k) for k, v in out.items()])
