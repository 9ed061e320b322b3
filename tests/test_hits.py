"""Hits among the first five of fifty questions over fifty rows, with the floors of the baseline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import composite, retrieval
from tidemark.plugins import embedders

#: (text, question in its own words, question in other words)
FACTS = [
    ("The backup server in Oslo runs every night at two", "backup server Oslo", "when does the Oslo copy of the data start"),
    ("Maria works as a nurse at the children's hospital", "Maria nurse hospital", "what is the career of Maria"),
    ("The red bicycle was sold to a neighbour in March", "red bicycle sold", "who bought the bicycle"),
    ("Invoice 4711 was paid by the Danish branch", "invoice 4711 paid", "which branch settled invoice 4711"),
    ("Our parser fails on nested quotes since release 3.2", "parser nested quotes", "why does release 3.2 break on quotes"),
    ("The garden gate needs new hinges before winter", "garden gate hinges", "what has to be repaired at the gate"),
    ("Pedro is allergic to peanuts and to cats", "Pedro allergic peanuts", "what should Pedro not eat"),
    ("The quarterly report is due on the tenth of April", "quarterly report April", "what is the date of the report"),
    ("Sofia moved from Lisbon to Vienna two years ago", "Sofia Lisbon Vienna", "where does Sofia live now"),
    ("The staging cluster has twelve nodes with 64 GB each", "staging cluster nodes", "how many machines has the staging cluster"),
    ("Tea is served at four in the small meeting room", "tea meeting room", "where is the tea"),
    ("The lighthouse keeper writes letters to his sister", "lighthouse keeper letters", "who writes to the sister of the keeper"),
    ("Config value cache.max_size must stay below 512", "cache.max_size", "limit of the cache size config"),
    ("The museum is closed on Mondays and on holidays", "museum closed Mondays", "on which days can we not visit the museum"),
    ("Anna attended the university of Uppsala for five years", "Anna university Uppsala", "which school did Anna go to"),
    ("The blue whale model hangs in the entrance hall", "blue whale model", "what hangs in the hall"),
    ("Payments in yen are rounded to whole numbers", "payments yen rounded", "how are amounts in yen stored"),
    ("The night train to Paris leaves from platform nine", "night train Paris", "where does the Paris train leave"),
    ("Kenji prefers short answers without greetings", "Kenji short answers", "how should we reply to Kenji"),
    ("The water pump was replaced after the flood", "water pump replaced", "what happened to the pump"),
    ("Our office dog Bruno sleeps under the printer", "office dog Bruno", "where does Bruno sleep"),
    ("The encryption key rotates every ninety days", "encryption key rotates", "how long is a key valid"),
    ("Lena sings in a choir on Thursday evenings", "Lena choir Thursday", "what does Lena do on Thursday"),
    ("The bridge over the canal carries ten tonnes at most", "bridge canal tonnes", "how heavy may a truck on the bridge be"),
    ("Search results are ranked by feedback and by layer", "results ranked feedback", "in which order do results come"),
    ("The bakery on the corner opens at six", "bakery corner opens", "when can we buy bread at the bakery"),
    ("Omar is planning a trip to Iceland in August", "Omar trip Iceland", "where is Omar going to travel"),
    ("The old elm in the yard is two hundred years old", "old elm yard", "age of the elm"),
    ("The retry limit of the mail queue is seven", "retry limit mail queue", "how many times does the mail queue try"),
    ("Greta collects stamps from South America", "Greta stamps America", "what are the stamps of Greta from"),
    ("数据库每天凌晨三点备份", "数据库 备份", "凌晨三点做什么"), ("小王喜欢喝绿茶", "小王 绿茶", "小王喜欢什么"), ("服务器机房在二楼东侧", "服务器 机房", "机房在哪里"),
    ("项目截止日期是六月三十日", "项目 截止日期", "项目什么时候截止"), ("会议室需要提前一天预订", "会议室 预订", "怎么预订会议室"),
    ("The harbour crane lifts containers of forty feet", "harbour crane containers", "what can the crane lift"),
    ("Nadia repairs violins in her workshop", "Nadia violins workshop", "what is the work of Nadia"),
    ("The fire drill takes place on the first Friday", "fire drill Friday", "when is the drill"),
    ("Logs older than a month are moved to cold storage", "logs cold storage", "what happens to old logs"),
    ("The chess club meets in the library", "chess club library", "where do the chess players meet"),
    ("Ivan speaks Russian, Polish and a little Greek", "Ivan Russian Polish", "which languages does Ivan know"),
    ("The solar panels produce nine kilowatts at noon", "solar panels kilowatts", "how much power do the panels give"),
    ("Feature flags are read once at startup", "feature flags startup", "when are flags loaded"),
    ("The bookshop gives students ten percent off", "bookshop students percent", "discount for students in the bookshop"),
    ("Clara is married to a pilot named Tom", "Clara married pilot", "what is the relationship status of Clara"),
    ("The river ferry does not run in heavy fog", "river ferry fog", "why is the ferry not running"),
    ("Version numbers follow year and month", "version numbers year month", "what do version numbers mean"),
    ("The choir of frogs keeps the guests awake", "choir frogs guests", "why can the guests not sleep"),
    ("Hugo paints houses on Lake Como", "Hugo paints Como", "where does Hugo paint"),
    ("The telescope on the roof points north", "telescope roof north", "direction of the telescope"),
]


@pytest.fixture(scope="module")
def store(spark):
    rows = [(i, t, "active", "me", 0, 0, "instant") for i, (t, _, _) in enumerate(FACTS)]
    rows += [(100 + i, t, "superseded", "me", 9, 0, "consolidated") for i, (t, _, _) in enumerate(FACTS[:20])] + [(200 + i, t, "active", "other", 9, 0, "consolidated") for i, (t, _, _) in enumerate(FACTS[:20])]
    return spark.createDataFrame(rows, "id long, content string, status string, user_id string, positive_feedback long, negative_feedback long, layer string")


def hits(found) -> float:
    return sum(r.id == r.query_id for r in found.collect()) / len(FACTS)


def test_questions_in_the_words_of_the_rows(spark, store):
    asked = [(i, q) for i, (_, q, _) in enumerate(FACTS)]
    seen = retrieval.visible(store, "me").select("id")
    best = retrieval.top(retrieval.bm25(store, asked, "id", "content").join(seen, "id"), 5, [F.col("score").desc(), F.col("id")])
    assert hits(best) >= 0.6 and best.filter("id >= 100").count() == 0


def test_questions_in_other_words(spark, store):
    # variants of every question in one batch, and the vectors of an embedder without a model
    asked = [(10 * i + j, v) for i, (_, _, q) in enumerate(FACTS) for j, v in enumerate(composite.variants(q))]
    seen = retrieval.visible(store, "me")
    words = retrieval.bm25(store, asked, "id", "content").join(seen.select("id"), "id").groupBy(F.floor(F.col("query_id") / 10).alias("query_id"), "id").agg(F.max("score").alias("score"))
    embedder = embedders.create("hashing", dim=256)
    vectors = np.asarray(embedder.embed([t for t, _, _ in FACTS])) @ np.asarray(embedder.embed([q for _, _, q in FACTS])).T
    near = spark.createDataFrame([(q, i, float(vectors[i, q])) for q in range(len(FACTS)) for i in np.argsort(-vectors[:, q])[:5].tolist()], "query_id long, id long, cosine double")
    both = words.join(near, ["query_id", "id"], "full_outer").select("query_id", "id", (F.coalesce("score", F.lit(0.0)) + F.coalesce("cosine", F.lit(0.0))).alias("score"))
    assert hits(retrieval.top(both, 5, [F.col("score").desc(), F.col("id")])) >= 0.4
