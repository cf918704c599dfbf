"""First assignments from known labels, local-parameter subsets, matrices, and held-out splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(key: str, seed: int) -> Column:
    """A number in (0, 1) from a hash of key and seed: the same on every engine and partitioning."""
    h = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    return (F.conv(F.substring(h, 1, 12), 16, 10).cast("double") + 1) / float(16**12 + 1)


def resp_from_labels(label: Column, k: int) -> Column:
    """One-hot ARRAY<DOUBLE> of k entries; negative or null labels share one more, garbage, entry at the end."""
    place = F.when((label >= 0) & (label < k), label).otherwise(F.lit(k))
    return F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: (i == place).cast("double"))


def with_empty(resp: Column, extra: int) -> Column:
    """``extra`` components without mass at the end."""
    return F.concat(resp, F.array_repeat(F.lit(0.0), extra))


def with_duplicates(resp: Column, copies: int, u: Column) -> Column:
    """Every component split into ``copies`` near-duplicates; a row belongs to one copy by ``u``."""
    own = F.floor(u * copies).cast("int")
    zeros = F.transform(resp, lambda _: F.lit(0.0))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda c: F.when(c == own, resp).otherwise(zeros)))


def with_junk(resp: Column, extra: int, share: float, u: Column) -> Column:
    """``extra`` junk components, each taking a ``share`` of the rows nearly whole (0.99)."""
    k = F.size(resp)
    junk = F.floor(u / share).cast("int")
    taken = junk < extra
    head = F.when(taken, F.transform(resp, lambda _: F.lit(0.01) / k)).otherwise(resp)
    tail = F.transform(F.sequence(F.lit(0), F.lit(extra - 1)), lambda i: F.when(i == junk, 0.99).otherwise(0.0))
    return F.concat(head, tail)


def subdivided(df: DataFrame, group: str, order: list[str], label: str, parts: int) -> DataFrame:
    """Adds ``sub``: each contiguous stretch of a label cut into ``parts`` even blocks, numbered label * parts + block."""
    w = Window.partitionBy(group).orderBy(*order)
    rows = df.withColumn("_new", (~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("int"))
    rows = rows.withColumn("_block", F.sum("_new").over(w))
    tile = F.ntile(parts).over(Window.partitionBy(group, "_block").orderBy(*order)) - 1
    return rows.withColumn("sub", F.col(label) * parts + tile).drop("_new", "_block")


def without_words(mass: DataFrame, topic: str, target: int, n: int) -> DataFrame:
    """(doc_id, word, topic, mass) with the target topic's ``n`` heaviest words taken from it."""
    heavy = mass.where(F.col(topic) == target).groupBy("word").agg(F.sum("mass").alias("_m")).orderBy(F.desc("_m"), "word").limit(n).select("word", F.lit(target).alias(topic))
    return mass.join(F.broadcast(heavy), ["word", topic], "left_anti")  # n words


def restricted_resp(scores: Column, log_pi: Column, target: Column, floor: float = 1e-40) -> Column:
    """Splits a row's mass in one component over fresh ones: softmax(scores + log pi) times the target's responsibility."""
    from mixloom.functions.numeric import exp_normalise_col

    both = F.zip_with(scores, log_pi, lambda a, b: a + b)
    return F.transform(exp_normalise_col(both, floor), lambda r: r * target)


def filled(df: DataFrame, part: DataFrame, key: str, value: str) -> DataFrame:
    """Values of ``part`` put back over those of ``df``; rows that ``part`` lacks keep theirs."""
    new = part.select(key, F.col(value).alias("_new"))
    return df.join(new, key, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def token_resp(bag: DataFrame, doc_resp: DataFrame) -> DataFrame:
    """(doc_id, word, k, r): each token takes its document's responsibilities (doc_id, k, r)."""
    return bag.select("doc_id", "word").join(doc_resp, "doc_id")


def doc_resp(tokens: DataFrame) -> DataFrame:
    """(doc_id, k, r): the unweighted mean over a document's tokens of (doc_id, word, k, r)."""
    n = tokens.select("doc_id", "word").distinct().groupBy("doc_id").agg(F.count("*").alias("_n"))
    return tokens.groupBy("doc_id", "k").agg(F.sum("r").alias("_s")).join(n, "doc_id").select("doc_id", "k", (F.col("_s") / F.col("_n")).alias("r"))


def word_resp(tokens: DataFrame) -> DataFrame:
    """(word, k, r): the mean over the documents that hold a word; words of no document have no row."""
    return tokens.groupBy("word", "k").agg(F.avg("r").alias("r"))


def doc_word_matrix(bag: DataFrame, words: list[str], *, binary: bool = False) -> DataFrame:
    """Documents by the given words, for a handful of words; documents with none of them have no row."""
    value = F.lit(1.0) if binary else F.sum("word_count")
    own = bag.where(F.col("word").isin(words)).groupBy("doc_id").pivot("word", words)
    return (own.agg(F.max(value)) if binary else own.agg(value)).na.fill(0.0, subset=words)


def adjacency(edges: DataFrame, nodes: list[int]) -> DataFrame:
    """Adjacency rows (src, ARRAY values) over few nodes; null where there is no edge."""
    x = F.map_from_entries(F.collect_list(F.struct("dst", "x")))
    return edges.groupBy("src").agg(x.alias("_m")).select("src", F.array(*[F.col("_m")[F.lit(n).cast("bigint")] for n in nodes]).alias("values"))


def within_budget(plan: DataFrame, tier: str, size: str, most: int) -> DataFrame:
    """Planned moves in order of ``tier`` while the running total of ``size`` stays within ``most``; K-sized."""
    return plan.withColumn("_run", F.sum(size).over(Window.orderBy(tier).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_run") <= most).drop("_run")


def heldout_plan(n_seen: Column, vocab: int, *, share: float = 0.2, ratio: float = 1 / 9, least: int = 10) -> Column:
    """STRUCT (train, seen, unseen): how many of a document's words to train on, and how many seen
    and unseen ones to hold out.

    Wanted are ``share`` of the seen words; the unseen words that there are allow ``ratio`` of
    their number. The smaller of both is held out, with 1 / ``ratio`` unseen words each. All
    wanted words leave the training part even where fewer are used. Less than ``least`` words on
    either side is an error."""
    wanted = F.greatest(F.ceil(n_seen * share), F.lit(least))
    allowed = F.floor((F.lit(vocab) - n_seen) * ratio + 1e-9)
    seen = F.least(wanted, allowed)
    why = F.when(n_seen < 2 * least, "too few seen words").when(allowed < least, "too few unseen words for the wanted ratio")
    checked = F.when(why.isNull(), seen).otherwise(F.raise_error(why).cast("bigint"))
    return F.struct((n_seen - wanted).cast("int").alias("train"), checked.cast("int").alias("seen"), F.ceil(checked / ratio - 1e-9).cast("int").alias("unseen"))


def vocab_split(bag: DataFrame, vocab: DataFrame, **sizes) -> DataFrame:
    """(doc_id, word, part) with part train_seen, heldout_seen, spare_seen or heldout_unseen; words are
    drawn by hash. The rest of the vocabulary, unseen and in training, has no rows.

    A document meets a stretch of the vocabulary (in the order of a hash, from a place of its
    own) that is as long as its seen and held-out words together, which is enough whatever it holds."""
    words = vocab.select("word").distinct()
    n_vocab = words.count()
    own = bag.select("doc_id", "word").distinct()
    plan = own.groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("p", heldout_plan(F.col("n"), n_vocab, **sizes))
    by_hash = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "word")), "word"))
    part = F.when(by_hash <= F.col("p.train"), "train_seen").when(by_hash <= F.col("p.train") + F.col("p.seen"), "heldout_seen").otherwise("spare_seen")
    seen = own.join(plan, "doc_id").select("doc_id", "word", part.alias("part"))
    ordered = words.withColumn("place", F.row_number().over(Window.orderBy(F.md5("word"), "word")) - 1)
    begin = F.pmod(F.xxhash64("doc_id"), F.lit(n_vocab))
    reach = F.least(F.col("n") + F.col("p.unseen"), F.lit(n_vocab)) - 1
    asked = plan.select("doc_id", "p", begin.alias("begin"), F.explode(F.sequence(F.lit(0).cast("bigint"), reach.cast("bigint"))).alias("step"))
    asked = asked.withColumn("place", F.pmod(F.col("begin") + F.col("step"), F.lit(n_vocab))).join(ordered, "place").join(own, ["doc_id", "word"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("step"))
    unseen = asked.withColumn("_r", rank).where(F.col("_r") <= F.col("p.unseen")).select("doc_id", "word", F.lit("heldout_unseen").alias("part"))
    return seen.unionByName(unseen)


def misaligned(pairs: DataFrame, true: str, found: str) -> DataFrame:
    """(found, n, share) per found label: the share of its rows outside its commonest true label, largest first."""
    per = pairs.groupBy(found, true).agg(F.count("*").alias("c")).groupBy(found).agg(F.sum("c").alias("n"), F.max("c").alias("_m"))
    return per.select(found, "n", ((F.col("n") - F.col("_m")) / F.col("n")).alias("share")).orderBy(F.desc("share"), found)
