"""Words, stop words and keywords.

Words are runs of letters and digits in lower case. A run of CJK ideographs has no spaces, so it
gives its overlapping pairs of characters instead (a single ideograph gives itself).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDEOGRAPH = r"[\x{4E00}-\x{9FFF}]"
_OTHER = r"[\p{L}\p{N}&&[^\x{4E00}-\x{9FFF}]]+"
#: Looks at a word and then steps over one ideograph or one whole other word, so that pairs overlap.
_MIXED = rf"(?=({IDEOGRAPH}{{2}}|(?<!{IDEOGRAPH}){IDEOGRAPH}(?!{IDEOGRAPH})|{_OTHER}))(?:{IDEOGRAPH}|{_OTHER})"
_PLAIN = r"([\p{L}\p{N}]+)"
#: Words that are no keywords.
STOP_WORDS = (
    "的", "了", "是", "在", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也",
    "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好", "自己", "这",
)


def words(text: Column) -> Column:
    """array<string> of a text's words, in order. Only a text with ideographs needs the longer pattern."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(text.rlike(IDEOGRAPH), F.regexp_extract_all(low, F.lit(_MIXED), F.lit(1))).otherwise(F.regexp_extract_all(low, F.lit(_PLAIN), F.lit(1)))


def kept_words(tokens: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Words longer than one character that are no stop words; all words where none is left."""
    good = F.filter(tokens, lambda w: (F.length(w) > 1) & ~w.isin(*stop_words))
    return F.when(F.size(good) > 0, good).otherwise(tokens)


def keywords(questions: DataFrame, key: str, text: str, top_k: int = 5, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """key, keyword, freq, rank: each text's most frequent words, ties to the earlier one."""
    seen = questions.select(key, F.posexplode(kept_words(words(F.col(text)), stop_words)).alias("pos", "keyword"))
    counted = seen.groupBy(key, "keyword").agg(F.count(F.lit(1)).alias("freq"), F.min("pos").alias("first_pos"))
    order = Window.partitionBy(key).orderBy(F.desc("freq"), "first_pos")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k).drop("first_pos")
