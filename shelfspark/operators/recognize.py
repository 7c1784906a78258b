"""From read text to a product, a brand, a category, or nothing."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .written import written

STRONG_KEY = 5
FUZZY = 0.78


@F.pandas_udf(T.DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two strings by their longest matching blocks."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def _first_key(hits: DataFrame, by: str = "text_id") -> DataFrame:
    """The longest key of each text, the first product's of equals."""
    best = F.min(F.struct((-F.col("key_len")).alias("n"), "ord", "key", "sku_id"))
    return hits.groupBy(by).agg(best.alias("b")).select(by, "b.key", "b.sku_id", "b.ord")


def article_matches(texts: DataFrame, keys: DataFrame, candidates: str, least: int = 0) -> DataFrame:
    """Equality of a text's ``candidates`` with article keys."""
    tok = texts.select("text_id", F.explode(candidates).alias("key"))
    hits = tok.join(keys.where(F.col("kind") == "article").where(F.col("key_len") >= least), "key")
    return _first_key(hits)


#: Characters of the shortest pieces that keys are looked up by; keys are at least so long.
PIECE = 4
#: Longer pieces, for keys that have so many characters: there are far more of them, so few keys share one.
LONG_PIECES = (8, 16)


def _pieces(c: str, n: int):
    """All runs of ``n`` characters of a string, by their place from 0."""
    last = F.greatest(F.char_length(c) - n, F.lit(-1))
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.col(c).substr(i + 1, F.lit(n))))


def keys_inside(hay: DataFrame, keys: DataFrame, n: int = PIECE, keep: tuple[str, ...] = ("text_id",)) -> DataFrame:
    """Model keys of ``n`` characters or more inside ``hay``: ``keep`` columns, the key's
    and its first product's.

    Each key is anchored at the piece of it that fewest keys share, of the greatest
    of a few lengths that it has; a text's pieces meet anchors in an equality join
    and the rest of the key is compared in place, so neither texts and keys nor all
    substrings are paired.  Rows are many more than their tables' files let
    expect, so these joins are never by broadcast."""
    models = (
        keys.where((F.col("kind") == "model") & (F.col("key_len") >= n))
        .groupBy("key", "key_len")
        .agg(F.min(F.struct("ord", "sku_id")).alias("p"))
        .select("key", "key_len", "p.sku_id", "p.ord")
    )
    lengths = [n, *[m for m in LONG_PIECES if m > n]]
    longest = F.coalesce(*[F.when(F.col("key_len") >= m, _pieces("key", m)) for m in reversed(lengths)])
    pieces = models.select("key", F.posexplode(longest).alias("off", "piece"))
    shared = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n_keys"))
    anchors = (
        pieces.join(shared.hint("merge"), "piece")
        .groupBy("key")
        .agg(F.min(F.struct("n_keys", "off", "piece")).alias("a"))
        .select("key", F.col("a.off").alias("off"), F.col("a.piece").alias("piece"))
    )
    parts = F.array(*[F.coalesce(_pieces("hay", m), F.array().cast("array<string>")) for m in lengths])
    found = (
        hay.select(*keep, "hay", F.explode(parts).alias("parts"))
        .select(*keep, "hay", F.posexplode("parts").alias("at", "piece"))
        .join(anchors.hint("merge"), "piece")
        .where((F.col("at") >= F.col("off")) & (F.col("hay").substr(F.col("at") - F.col("off") + 1, F.char_length("key")) == F.col("key")))
        .select(*keep, "key")
        .distinct()
    )
    return found.join(models.hint("merge"), "key")


def substring_matches(texts: DataFrame, keys: DataFrame, haystacks: str, least: int = 0) -> DataFrame:
    """The longest model key inside any of a text's ``haystacks``."""
    hay = texts.select("text_id", F.explode(haystacks).alias("hay")).distinct()
    keys = written(keys)  # read several times
    return _first_key(keys_inside(hay, keys, max(PIECE, least)))


def exact_brands(texts: DataFrame, brands: DataFrame) -> DataFrame:
    """The longest brand that is a token of the text."""
    tok = texts.select("text_id", F.explode("tokens").alias("brand_canon")).join(brands, "brand_canon")
    best = F.min(F.struct((-F.char_length("brand_canon")).alias("n"), "ord", "brand", "brand_canon"))
    return tok.groupBy("text_id").agg(best.alias("b")).select("text_id", "b.brand", "b.brand_canon")


def fuzzy_brands(texts: DataFrame, brands: DataFrame, least: float = FUZZY, keep: tuple[str, ...] = ("text_id",)) -> DataFrame:
    """The most similar brand of each text's tokens (five letters and up on both
    sides); of equals the longest, then the first of the catalog.

    Of strings of lengths a and b whose ratio reaches ``least``, at most
    u = (1 - least) (a + b) letters are in no matching block, so there are u + 1
    blocks at most and, from 0.75 on, one of them has two letters; it is moved by
    no more than u.  So distinct tokens meet the brands that share a pair of
    letters at such places, and only those pairs are compared."""
    if least < 0.75:
        raise ValueError("pairs of letters are enough from a ratio of 0.75 on")
    tok = texts.select(*keep, F.explode("tokens").alias("token")).where(F.char_length("token") >= 5)
    words = tok.select("token").distinct().withColumn("n", F.char_length("token"))
    names = brands.where(F.char_length("brand_canon") >= 5).withColumn("m", F.char_length("brand_canon"))
    high = (2 - least) / least  # the ratio is at most twice the shorter length over the sum
    moved = F.floor((1 - least) * (1 + high) * F.col("m")).cast("int")
    pairs = names.select("brand", "brand_canon", "ord", "m", moved.alias("u"), F.posexplode(_pieces("brand_canon", 2)).alias("p", "pair"))
    placed = pairs.select("brand", "brand_canon", "ord", "m", "pair", F.explode(F.sequence(F.greatest(F.col("p") - F.col("u"), F.lit(0)), F.col("p") + F.col("u"))).alias("at"))
    met = (
        words.select("token", "n", F.posexplode(_pieces("token", 2)).alias("at", "pair"))
        .join(placed, ["pair", "at"])
        .where(F.least("n", "m") * 2 >= least * (F.col("n") + F.col("m")))
        .select("token", "brand", "brand_canon", "ord", "m")
        .distinct()
    )
    scored = met.withColumn("ratio", ratio_udf("token", "brand_canon")).where(F.col("ratio") >= least)
    hits = tok.join(scored, "token")
    best = F.min(F.struct((-F.col("ratio")).alias("r"), (-F.col("m")).alias("m"), "ord", "brand", "brand_canon"))
    return hits.groupBy(*keep).agg(best.alias("b")).select(*keep, "b.brand", "b.brand_canon", (-F.col("b.r")).alias("ratio"))


def category_matches(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The longest category noun that is a token of the text."""
    tok = texts.select("text_id", F.explode("tokens").alias("keyword")).join(vocabulary, "keyword")
    best = F.min(F.struct((-F.char_length("keyword")).alias("n"), "first", "display", "keyword"))
    return tok.groupBy("text_id").agg(best.alias("b")).select("text_id", F.col("b.display").alias("category"), F.col("b.keyword").alias("keyword"))


def match_text(texts: DataFrame, catalog: DataFrame, keys: DataFrame, brands: DataFrame, vocabulary: DataFrame, fuzzy: bool = True) -> DataFrame:
    """``text_id``, ``text`` to a decision: a product on strong evidence, else
    brand and category from printed words and weak codes, else unknown.

    Each distinct text is decided once, however many rows hold it."""
    # by number, so that few bytes but much work are not put into one task
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = texts.select("text").distinct().repartition(parts, F.xxhash64("text")).select(F.xxhash64("text").alias("text_id"), "text").withColumns(
        {
            "comp": X.compact("text"),
            "tokens": X.tokens("text"),
            "articles": X.article_candidates("text"),
        }
    )
    t = t.withColumns(
        {
            "literal": F.when(F.col("comp") != "", X.code_variants("comp")).otherwise(F.array().cast("array<string>")),
            "confused": F.when(F.col("comp") != "", X.confusion_variants("comp")).otherwise(F.array().cast("array<string>")),
        }
    )
    t = written(t)  # read by every branch below
    keys = written(keys.repartition(parts, "key"))
    n = F.char_length("key")

    def told(hits: DataFrame, p: int, method: str, conf) -> DataFrame:
        return _first_key(hits).select("text_id", F.lit(p).alias("p"), "key", "sku_id", F.lit(method).alias("method"), conf.alias("conf"))

    # the literal forms are among the confused ones, so all meet the keys once
    hay = t.select("text_id", "literal", F.explode("confused").alias("hay"))
    inside = written(keys_inside(hay.select("text_id", "hay", F.array_contains("literal", F.col("hay")).alias("sure")), keys, keep=("text_id", "sure")))
    coded = written(t.select("text_id", F.explode("tokens").alias("key")).join(keys.where("kind = 'article'").drop("kind"), "key"))
    strong = (
        article_matches(t, keys, "articles").select("text_id", F.lit(1).alias("p"), "key", "sku_id", F.lit("article_code").alias("method"), F.when(n >= 6, 0.9).otherwise(0.78).alias("conf"))
        .unionByName(told(inside.where(F.col("sure") & (F.col("key_len") >= STRONG_KEY)), 2, "model_code", F.when(n >= 6, 0.9).otherwise(0.8)))
        .unionByName(told(coded.where("key_len >= 6"), 3, "article_code", F.lit(0.9)))
        .groupBy("text_id")
        .agg(F.min_by(F.struct("key", "sku_id", "method", "conf"), "p").alias("strong"))
    )
    weak = (
        _first_key(inside).select("text_id", F.lit(1).alias("p"), "key", "sku_id")
        .unionByName(_first_key(coded).select("text_id", F.lit(2).alias("p"), "key", "sku_id"))
        .groupBy("text_id")
        .agg(F.min_by(F.struct("key", "sku_id"), "p").alias("weak"))
    )
    brand = exact_brands(t, brands)
    if fuzzy:
        rest = t.join(brand, "text_id", "left_anti")
        brand = brand.unionByName(fuzzy_brands(rest, brands).drop("ratio"))
    entry = catalog.select("sku_id", F.struct("sku_id", "brand_name", "model_name", "category", "is_own_brand", F.array_join("article_codes", "|").alias("codes"), X.canon("brand_name").alias("canon")).alias("e"))
    out = (
        t.join(strong, "text_id", "left").join(weak, "text_id", "left").join(brand, "text_id", "left").join(category_matches(t, vocabulary), "text_id", "left")
        .join(entry.select(F.col("sku_id").alias("_s"), F.col("e").alias("s")), F.col("strong.sku_id") == F.col("_s"), "left")
        .join(entry.select(F.col("sku_id").alias("_w"), F.col("e").alias("w")), F.col("weak.sku_id") == F.col("_w"), "left")
    )
    by_code = F.col("brand").isNull() & F.col("w").isNotNull() & (F.char_length("weak.key") >= STRONG_KEY)
    found = F.when(by_code, F.col("w.brand_name")).otherwise(F.col("brand"))
    found_canon = F.when(by_code, F.col("w.canon")).otherwise(F.col("brand_canon"))
    cat = F.coalesce("category", F.when(found_canon == F.col("w.canon"), X.falsy_null("w.category")))
    sure, branded = F.col("strong").isNotNull(), found.isNotNull()

    def pick(a, b, c, d):
        return F.when(sure, a).when(branded, b).when(cat.isNotNull(), c).otherwise(d)

    null = F.lit(None).cast("string")
    decided = out.select(
        F.col("text").alias("_text"),
        pick(F.lit("matched_sku"), F.lit("brand_only"), F.lit("category_only"), F.lit("unknown")).alias("status"),
        pick(F.col("s.is_own_brand"), F.when(by_code, F.col("w.is_own_brand")).otherwise(F.lit(True)), F.lit(False), F.lit(False)).alias("is_own"),
        pick(F.col("s.brand_name"), found, null, null).alias("brand"),
        F.when(sure, F.col("s.model_name")).alias("model"),
        pick(F.col("s.category"), cat, cat, null).alias("category"),
        F.when(sure, F.col("s.sku_id")).alias("sku_id"),
        F.when(sure, F.col("s.codes")).alias("article_codes"),
        pick(F.col("strong.conf"), F.when(cat.isNotNull(), 0.62).otherwise(0.6), F.lit(0.45), F.when(F.size("tokens") > 0, 0.3).otherwise(0.15)).alias("confidence"),
        pick(
            F.col("strong.method"),
            F.when(cat.isNotNull(), F.lit("brand+category")).when(by_code, F.lit("brand_from_code")).otherwise(F.lit("brand_text")),
            F.lit("category_text"),
            F.lit("no_match"),
        ).alias("method"),
        pick(F.col("strong.key"), found_canon, F.col("keyword"), null).alias("matched_key"),
    )
    rows = texts.select("text_id", "text")
    return rows.join(decided, F.col("text").eqNullSafe(F.col("_text")), "left").drop("_text")


def vote_winner(reads: DataFrame, keys: list[str]) -> DataFrame:
    """Per object the product with the most reads, then the best score, then the first."""
    votes = reads.where(F.col("sku_id").isNotNull()).groupBy(*keys, "sku_id").agg(F.count(F.lit(1)).alias("votes"), F.max("score").alias("score"), F.min("ord").alias("ord"))
    best = F.max_by(F.struct("sku_id", "votes", "score"), F.struct("votes", "score", -F.col("ord")))
    return votes.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def rotation_mode(reads: DataFrame, keys: list[str], top: int = 8, least: int = 2) -> DataFrame:
    """The most frequent rotation among the most confident objects that were
    recognised at all, if ``least`` agree; the first seen of equals."""
    w = Window.partitionBy(*keys).orderBy(F.desc("peak_conf"), "ord")
    tops = reads.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top).where("status <> 'unknown'")
    counted = tops.groupBy(*keys, "rotation").agg(F.count(F.lit(1)).alias("votes"), F.min("_n").alias("first"))
    best = counted.groupBy(*keys).agg(F.max_by(F.struct("rotation", "votes"), F.struct("votes", -F.col("first"))).alias("b"))
    return best.select(*keys, "b.*").where(F.col("votes") >= least)


def first_stop_best(reads: DataFrame, keys: list[str], stops, order: str = "ord", score: str = "score") -> DataFrame:
    """Reads in order up to the first that ``stops``; of those the best score, the first of equals."""
    cut = F.min(F.when(stops, F.col(order))).over(Window.partitionBy(*keys))
    upto = reads.withColumn("_cut", cut).where(F.col("_cut").isNull() | (F.col(order) <= F.col("_cut")))
    best = F.max_by(F.struct(*reads.columns), F.struct(score, -F.col(order)))
    return upto.groupBy(*keys).agg(best.alias("b"), F.count(F.lit(1)).alias("n_read")).select("b.*", "n_read")


def own_brand_text(texts: DataFrame, needles: list[str], short_words: list[str], keys: list[str]) -> DataFrame:
    """Whether a box's texts name an own brand: a needle anywhere in the compact
    text, or a short word on its own read with some confidence; the first such text."""
    norm = X.compact_stripped("text")
    hit = F.lit(False)
    for n in needles:
        hit = hit | norm.contains(n)
    short = F.arrays_overlap(F.regexp_extract_all(norm, F.lit("[A-ZА-ЯЁ]{2,}"), F.lit(0)), F.array(*map(F.lit, short_words)))
    found = texts.withColumn("_hit", hit | (short & (F.col("conf") >= 0.45)))
    reason = F.min_by(F.concat(F.lit("ocr:"), "text"), F.when(F.col("_hit"), F.col("ord")))
    return found.groupBy(*keys).agg(F.bool_or("_hit").alias("is_own"), F.when(F.bool_or("_hit"), reason).otherwise("").alias("reason"))
