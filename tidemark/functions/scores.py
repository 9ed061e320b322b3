"""Scores kept as JSON maps, similarity of vectors, ranking scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The domains of a memory, in their order.
DOMAINS = ["identity", "workflow", "behavior", "strategy", "rule", "raw_fact"]
# Boosts of layers in ranking.
LAYER_BOOST = {"consolidated": 0.10, "candidate": 0.05}


def score_map(json: Column) -> Column:
    """Map of a JSON object text; empty where the text is no JSON object."""
    return F.coalesce(F.from_json(json, "map<string,double>"), F.create_map().cast("map<string,double>"))


def top_domain(scores: Column) -> Column:
    """Domain of the highest score above 0, the first in domain order on ties."""
    pairs = F.array(*[F.struct(F.coalesce(scores[d], F.lit(0.0)).alias("s"), F.lit(-i).alias("i"), F.lit(d).alias("d"))
                      for i, d in enumerate(DOMAINS)])
    best = F.array_max(F.filter(pairs, lambda p: p["s"] > 0))
    return best["d"]


def empty_scores() -> Column:
    """The map of all domains with no score."""
    return F.create_map(*[x for d in DOMAINS for x in (F.lit(d), F.lit(0.0))])


def _any_of(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(words))


# Words by which a text speaks of a domain.
OWN_WORDS, RULE_WORDS = ["我", "偏好", "喜欢", "习惯", "用"], ["应该", "必须", "不能", "可以", "要"]
STRATEGY_WORDS = ["股票", "仓位", "止损", "买入", "卖出", "策略"]
CODE_WORDS, TASTE_WORDS = ["代码", "函数", "bug", "编程"], ["喜欢", "偏好", "风格", "习惯"]
# Confidence shown for a layer.
LAYER_CONFIDENCE = {"instant": 0.40, "candidate": 0.70, "consolidated": 0.90}


def text_domain(text: Column) -> Column:
    """Domain of a text by its words; how long it is tells apart two that share words."""
    low, n = F.lower(text), F.length(text)
    return (
        F.when(_any_of(low, OWN_WORDS), F.when(n < 40, "identity").otherwise("behavior"))
        .when(_any_of(low, RULE_WORDS), F.when(n < 60, "rule").otherwise("workflow"))
        .when(_any_of(low, STRATEGY_WORDS), "strategy").otherwise("raw_fact")
    )


def question_domain(question: Column, json: Column) -> Column:
    """Domain a found row is counted for: the greatest of its scores, the first one as written on
    ties, even if all are 0; without scores, by words of the question."""
    every = F.map_entries(score_map(json))
    top = F.array_max(F.transform(every, lambda e: e["value"]))
    first = F.get(F.filter(every, lambda e: e["value"] == top), F.lit(0))["key"]
    words = F.when(_any_of(question, CODE_WORDS), "workflow").when(_any_of(question, TASTE_WORDS), "behavior").otherwise("raw_fact")
    return F.coalesce(first, words)


def layer_confidence(layer: Column) -> Column:
    table = F.create_map(*[F.lit(x) for p in LAYER_CONFIDENCE.items() for x in p])
    return F.try_element_at(table, layer)


def in_trading_hours(at: Column, shift: int = 8, opens: int = 9, closes: int = 15) -> Column:
    """Whether the hour of ``at`` plus ``shift``, without carry over midnight, is in trading hours."""
    return (F.hour(at) + shift).between(opens, closes)


def added(scores: Column, more: Column) -> Column:
    """Key-wise sum of two maps."""
    return F.map_zip_with(scores, more, lambda k, a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))


def weight(positive: Column, negative: Column) -> Column:
    """Feedback weight: a negative one counts twice."""
    return positive - 2 * negative


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null for unequal lengths or a zero norm."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms)


def rerank_score(base: Column, positive: Column, negative: Column, layer: Column) -> Column:
    """Base score (0.5 where there is none) plus feedback and layer boosts, four decimals."""
    boost = F.lit(0.0)
    for name, b in LAYER_BOOST.items():
        boost = F.when(layer == name, b).otherwise(boost)
    base = F.coalesce(F.when(base != 0, base), F.lit(0.5))
    return F.round(base + 0.05 * weight(positive, negative) + boost, 4)
