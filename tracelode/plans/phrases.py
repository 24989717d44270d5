"""Phrase and skill plans over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode.functions import text
from tracelode.operators import phrases, usage
from tracelode.operators.sequence import top_per_group
from tracelode.plans.base import plan


@plan()
def phrase_ngrams_en(t):
    messages = t.conversations.select("conv_id", "role", "turn", "text")
    found = phrases.message_phrases(phrases.without_replays(messages, "conv_id", "turn"), ["conv_id", "role", "turn"])
    return found.groupBy("role", "phrase", "segmentation").agg(F.sum("occurrences").alias("occurrences"), F.count_distinct("conv_id").alias("sessions"))


@plan("""
WITH w AS (SELECT role, unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM conversations),
c AS (SELECT role, w, count(*) AS n FROM w WHERE length(w) >= 2 GROUP BY 1, 2)
SELECT * FROM (SELECT role, w, n, CAST(row_number() OVER (PARTITION BY role ORDER BY n DESC, length(w) DESC, w) AS INTEGER) AS rank FROM c) WHERE rank <= 240""")
def phrase_topk(t):
    words = t.conversations.select("role", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where(F.length("w") >= 2)
    counts = words.groupBy("role", "w").agg(F.count("*").alias("n"))
    return top_per_group(counts, ["role"], [F.desc("n"), F.desc(F.length("w")), F.asc("w")], 240)


@plan()
def phrase_cloud(t):
    messages = t.conversations.select(F.col("conv_id").alias("session_id"), "role", "turn", "text")
    found = phrases.message_phrases(messages, ["session_id", "role"])
    return phrases.cloud(found.withColumns({"agent": F.lit("codex"), "model": F.lit(None).cast("string")}))


@plan("""
WITH w AS (SELECT conv_id, role, turn, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM conversations),
g AS (SELECT conv_id, role, array_to_string(w[i : i + n - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, unnest([1, 2, 3]) AS n FROM w) WHERE len(w) >= n)),
f AS (SELECT conv_id, role, phrase, count(*) AS n FROM g GROUP BY ALL),
s AS (SELECT role, phrase, sum(n) AS n, count(DISTINCT conv_id) AS sessions FROM f GROUP BY ALL HAVING count(DISTINCT conv_id) >= 2),
p AS (SELECT role, array_to_string(t[i : i + m - 1], ' ') AS phrase, max(n) AS longer FROM (SELECT *, unnest(range(1, len(t) - m + 2)) AS i FROM (SELECT role, n, string_split(phrase, ' ') AS t, unnest(range(1, len(string_split(phrase, ' ')))) AS m FROM s)) GROUP BY ALL),
k AS (SELECT s.* FROM s LEFT JOIN p USING (role, phrase) WHERE longer IS NULL OR longer < 0.8 * n),
r AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, length(phrase) DESC, phrase) AS rank FROM k),
d AS (SELECT role, phrase, 'a' || conv_id % 3 AS agent, sum(n) AS n FROM f GROUP BY ALL), e AS (SELECT role, phrase, arg_min(agent, (-n, agent)) AS dominant_agent FROM d GROUP BY ALL)
SELECT role, phrase, CAST(n AS BIGINT) AS occurrences, sessions, n / max(n) OVER (PARTITION BY role) AS weight, dominant_agent, CAST(rank AS BIGINT) AS rank FROM r JOIN e USING (role, phrase) WHERE rank <= 300""")
def phrase_cloud_of_words(t):
    words = t.conversations.select("conv_id", "role", F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "").alias("w"))
    runs = F.flatten(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>"))))
    found = words.select(F.col("conv_id").alias("session_id"), "role", F.explode(runs).alias("phrase"), F.lit(1).cast("long").alias("occurrences"))
    found = found.withColumns({"agent": F.concat(F.lit("a"), (F.col("session_id") % 3).cast("string")), "model": F.lit(None).cast("string")})
    return phrases.cloud(found, most=300).select("role", "phrase", "occurrences", "sessions", "weight", "dominant_agent", F.col("rank").cast("long").alias("rank"))


@plan("""
WITH t AS (SELECT regexp_replace(lower(text), '[^a-j]', '', 'g') AS t FROM documents),
g AS (SELECT substr(t, i, n) AS p FROM (SELECT *, unnest(range(1, length(t) - n + 2)) AS i FROM (SELECT *, unnest([3, 4]) AS n FROM t) WHERE length(t) >= n))
SELECT translate(p, 'abcdefghij', '中文分词项目运行测试') AS phrase, count(*) AS occurrences FROM g GROUP BY p HAVING count(*) >= 20""")
def chinese_character_phrases(t):
    """Every run of three or four characters counts, wherever it begins. The texts' letters a to j stand for ten characters."""
    text = F.translate(F.regexp_replace(F.lower("text"), "[^a-j]", ""), "abcdefghij", "中文分词项目运行测试")
    return phrases.character_phrases(t.documents.select(text.alias("text")), 4).where("occurrences >= 20")


SKILLS = ("grill-me", "pdf", "github:yeet")
PROMPTS = ("Use the PDF skill now", "run $grill-me twice", "see [$github:yeet](x)", "open $HOME/bin", "plain words")


@plan("""
WITH u AS (SELECT user_id, CASE event_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'grill-me' WHEN 2 THEN 'github:yeet' END AS skill FROM events)
SELECT skill, count(*) AS uses, count(DISTINCT user_id) AS sessions FROM u WHERE skill IS NOT NULL GROUP BY 1 UNION ALL SELECT 'unused', 0, 0""")
def skill_mentions(t):
    prompt = F.element_at(F.array(*[F.lit(p) for p in PROMPTS]), (F.col("event_id") % 5 + 1).cast("int"))
    uses = t.events.select(F.col("user_id").alias("session_id"), F.explode(text.skill_mentions(prompt, list(SKILLS))).alias("skill"))
    installed = t._spark_frame(["unused", "pdf"], "skill")
    return usage.skill_ranking(uses, installed).select("skill", "uses", "sessions")
