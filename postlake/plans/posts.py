"""Derived posts: events joined with a literal table of our own short texts.

``TEMPLATES`` holds inputs only; every result is computed by the queries. Both
engines read the same literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEMPLATES: list[tuple[str, str | None]] = [
    ("The new dashboard is clean and the export tool is fast.", None),
    ("Support never answered my ticket, worst service so far.", None),
    ("Checkout is slow but the design is great.", None),
    ("Not good. The app crashes every single morning!", None),
    ("I can't say I'm unhappy with the release", None),
    ("Yeah right, totally normal to lose my data again", None),
    ("brilliant work team", "We had a major outage last night and lost data"),
    ("this is garbage", "Deploy failed again and the incident is open"),
    ("amazing, so proud of you all", "We migrated with zero downtime ahead of schedule"),
    ("W", None),
    ("mid.", None),
    ("who let him cook on this release", None),
    ("let the devs cook, they know the plan", None),
    ("that demo lost aura for sure", None),
    ("plus 500 aura, +500 aura for the whole crew", None),
    ("sounds like a skill issue to me", None),
    ("nah this ain't it chief", None),
    ("very demure layout, very mindful", None),
    ("fully expected a disaster but it turned out clean and I love it", None),
    ("The migration does not fail to impress", None),
    ("It was nothing short of a disaster for our office", None),
    ("Great launch 🎉 and our server burns", None),
    ("A bold decision to remove the only button we used", None),
    ("Did someone accidentally push the intern branch", None),
    ("Loved the wait, said no one ever", None),
    ("It works great if you wanted to lose files", None),
    ("Thanks for breaking my build twice", None),
    ("imagine paying for a tool that can't even save", None),
    ("The render engine is totally sick", None),
    ("An egregious oversight by the vendor", None),
    ("The camera is great but the battery drains quickly", None),
    ("This rollout was a dumpster fire", None),
    ("That keynote was a mona lisa of slides", None),
    ("Cricket betting odds for the upcoming match", None),
    ("Meeting moved to four in the afternoon", None),
    ("The price is expensive and the subscription is a scam", None),
    ("Price is affordable, support is helpful and quick", None),
    ("no bugs since the patch, zero crashes", None),
    ("The interface is not bad, the speed is not slow", None),
    ("sooooo goooood!!! this slaps 🔥🔥", None),
    ("@friend look at https://example.org/page #BestDayEver", None),
    ("<b>bold</b> claims &amp; small print", None),
    ("this straight trash flop is big yikes 💩", None),
    ("no cap the update hits different ✨", None),
    ("I don't like it, it's janky and they've ignored us", None),
    ("we never had slow pages, however the search is broken", None),
    ("wah kya app hai, phone restart ho gaya", None),
    ("ekdum zeher update bhai", None),
    ("Payment failed and money debited, refund please", None),
    ("click here to claim your free subscription", None),
    ("photo by Ana on May 12", None),
    ("https://example.org/only", None),
    ("short", None),
    ("", None),
    ("Thank you, great and helpful team, I recommend it", None),
    ("The movie trailer and the music are a banger", None),
    ("Press release: quarterly financial statements are out", None),
    ("The theme looks stunning though loading takes hours", None),
    ("While the colors are good, the app is slow", None),
    ("RT @desk: https://example.org/a   Server   is down", None),
    ("server is down", None),
    ("खूप छान ॲप, पैसा वसूल", None),
    ("ॲप चांगला नाही आणि फोन हँग होतो", None),
    ("सगळे बग्स मिटले, आता फास्ट", None),
    ("terrible release, the worst of all", "Deploy failed and the incident is open"),
    ("let him cook, the new search is nice", None),
    ("shoutout to the infra crew for deleting staging", None),
    ("look wise it is clean, only issue is that login is useless", None),
    ("best app ever if you love losing files", None),
    ("धन्यवाद, माझा फोन हँग झाला", None),
    ("developers sleeping on the job again", None),
]
N = len(TEMPLATES)


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(TEMPLATES)], "tpl_id bigint, text string, context string")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post_id, user_id, ts, text, context, original: one row an event. The literal table has a fixed size and is broadcast."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.join(F.broadcast(templates(spark)), F.col("event_id") % F.lit(N) == F.col("tpl_id")).select(
        F.col("event_id").cast("long").alias("post_id"),
        "user_id",
        "ts",
        "text",
        "context",
        F.element_at(F.array(*[F.lit(x) for x in ("positive", "negative", "neutral", "")]), (F.col("event_id") % 7 % 4 + 1).cast("int")).alias("original"),
    )


def q(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


VALUES = ", ".join(f"({i}, {q(t)}, {q(c)})" for i, (t, c) in enumerate(TEMPLATES))
TPL_CTE = f"tpl(tpl_id, text, context) AS (VALUES {VALUES})"
CTE = f"""{TPL_CTE},
posts AS (SELECT CAST(event_id AS BIGINT) AS post_id, user_id, ts, text, context,
  (['positive', 'negative', 'neutral', ''])[event_id % 7 % 4 + 1] AS original
  FROM events JOIN tpl ON event_id % {N} = tpl_id)"""
