"""Hindi and Marathi text: phrase replacement, then a token scan with adjacent negation and resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases and words with weight and replacement.
PHRASES = {
    "पैसा वसूल": (2.5, "worth every penny full value for money great"),
    "पैसे वसूल": (2.5, "worth every penny full value for money great"),
    "खूप छान": (2.4, "extremely good fantastic wonderful"),
    "लय भारी": (2.5, "sensational awesome magnificent great"),
    "लाय भारी": (2.5, "sensational awesome magnificent great"),
    "एक नंबर": (2.4, "top notch first class superb amazing"),
    "फार छान": (2.3, "very good pleasant wonderful"),
    "अतिशय सुंदर": (2.5, "extremely beautiful gorgeous clean"),
    "मस्त काम": (2.2, "works great smooth fast excellent"),
    "खूप आवडले": (2.4, "loved it great experience delightful"),
    "खूप आवडला": (2.4, "loved it great experience delightful"),
    "खूप आवडली": (2.4, "loved it great experience delightful"),
    "चांगला आहे": (2.0, "very good nice reliable"),
    "चांगली आहे": (2.0, "very good nice reliable"),
    "चांगले आहे": (2.0, "very good nice reliable"),
    "खूप मदत": (2.0, "very helpful supportive responsive"),
    "धन्यवाद": (1.8, "thank you grateful appreciated"),
    "मनःपूर्वक आभार": (2.0, "heartfelt thanks wonderful service"),
    "पैसे वाया": (-2.5, "complete waste of money scam rip off"),
    "वाया गेले": (-2.4, "wasted ruined worthless lost"),
    "पैसे फुकट": (-2.4, "waste of money useless scam"),
    "कामाचा नाही": (-2.3, "completely useless unhelpful broken"),
    "कामाची नाही": (-2.3, "completely useless unhelpful broken"),
    "काही कामाचा नाही": (-2.5, "totally useless garbage failure"),
    "वाट लागली": (-2.5, "completely destroyed broken ruined disaster"),
    "वाट लावली": (-2.5, "completely destroyed broken ruined disaster"),
    "बंद पडतो": (-2.4, "crashes freezes stops working broken"),
    "बंद पडतोय": (-2.4, "crashes freezes stops working broken"),
    "चालत नाही": (-2.2, "not working fails error broken"),
    "चालत नाहीये": (-2.2, "not working fails error broken"),
    "डोकेदुखी झाली": (-2.3, "annoying headache frustrating terrible"),
    "त्रास होतो": (-2.0, "painful frustrating trouble annoying"),
    "त्रास होतोय": (-2.0, "painful frustrating trouble annoying"),
    "कोणतीही मदत नाही": (-2.4, "unresponsive zero support ghosted terrible"),
    "मदत मिळाली नाही": (-2.4, "unresponsive zero support ghosted terrible"),
    "खूप वाईट": (-2.4, "extremely bad terrible awful"),
    "फार वाईट": (-2.3, "very bad terrible awful"),
    "कचरा ॲप": (-2.5, "garbage trash bloatware useless"),
    "फालतू ॲप": (-2.5, "garbage useless trash buggy"),
    "बकवास सर्विस": (-2.5, "terrible worst service unresponsive"),
}
GOOD = {
    "अच्छा": (2.0, "good great wonderful fine"),
    "अच्छी": (2.0, "good great wonderful fine"),
    "अच्छे": (2.0, "good great wonderful fine"),
    "छान": (2.0, "great wonderful clean"),
    "मस्त": (2.0, "fantastic awesome great"),
    "उत्तम": (2.3, "excellent superb magnificent"),
    "सुंदर": (2.0, "beautiful clean visual masterpiece"),
    "बढ़िया": (2.2, "great wonderful splendid"),
    "शानदार": (2.4, "spectacular amazing phenomenal"),
    "लाजवाब": (2.4, "unmatched fabulous outstanding"),
    "झकास": (2.2, "fantastic superb awesome"),
    "कडक": (2.0, "sharp fantastic solid fire"),
    "भारी": (2.0, "awesome great solid"),
    "चांगला": (1.8, "good fine nice reliable"),
    "चांगली": (1.8, "good fine nice reliable"),
    "चांगले": (1.8, "good fine nice reliable"),
    "सोपा": (1.5, "easy intuitive clean"),
    "सोपी": (1.5, "easy intuitive clean"),
    "सोपे": (1.5, "easy intuitive clean"),
    "फास्ट": (1.8, "fast quick snappy smooth"),
    "सुरक्षित": (1.6, "safe secure trusted"),
    "उपयुक्त": (1.7, "useful helpful valuable"),
    "मदतशीर": (1.8, "helpful supportive responsive"),
    "आवडला": (1.8, "liked loved appreciated"),
    "आवडली": (1.8, "liked loved appreciated"),
    "आवडले": (1.8, "liked loved appreciated"),
    "आनंद": (1.6, "delight joy happy"),
    "सर्वोत्तम": (2.5, "best top world-class perfection"),
}
BAD = {
    "घटिया": (-2.4, "terrible worst horrible trash"),
    "बकवास": (-2.4, "nonsense trash garbage rubbish"),
    "बेकार": (-2.2, "useless bad waste broken"),
    "खराब": (-2.2, "bad spoiled broken damaged"),
    "फालतू": (-2.2, "useless rubbish junk stupid"),
    "कचरा": (-2.4, "garbage trash bloatware rubbish"),
    "रद्दी": (-2.2, "scrap useless junk waste"),
    "धोखा": (-2.5, "fraud scam cheat ripoff"),
    "लूट": (-2.4, "robbery extortion scam overpriced"),
    "त्रास": (-2.0, "pain trouble headache frustration"),
    "बग": (-1.8, "bug glitch defect error"),
    "बग्स": (-1.9, "bugs glitches defects errors"),
    "क्रैश": (-2.3, "crash freezes broken fails"),
    "हँग": (-2.1, "freeze lag stuck slow"),
    "स्लो": (-1.8, "slow laggy delay sluggish"),
    "हळू": (-1.7, "slow laggy sluggish delay"),
    "वायफळ": (-1.8, "pointless futile useless"),
    "महाग": (-1.9, "expensive overpriced costly"),
    "चुकीचे": (-1.8, "wrong incorrect erroneous bad"),
    "दिक्कत": (-1.8, "trouble issue problem headache"),
    "समस्या": (-1.7, "problem issue error defect"),
    "वाईट": (-2.2, "bad terrible awful unpleasant"),
    "अडचण": (-1.7, "obstacle difficulty issue problem"),
}
NEGATIONS = ["नाही", "नाहीत", "नाहीये", "नाहीयेत", "नव्हते", "नव्हती", "नव्हता", "नको", "नका", "नये", "नसेल", "नसतात", "नहीं", "मत", "ना", "बिना"]
RESOLUTIONS = ["मिटले", "मिटला", "दूर", "सॉल्व्ह", "दुरुस्त", "झाले", "झाला"]


def phrases(text: Column) -> Column:
    """struct(text, score): longest phrases first, weight times non-overlapping matches, on the mutating text."""
    table = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(PHRASES[p][0]).alias("w"), F.lit(f" {PHRASES[p][1]} ").alias("r")) for p in sorted(PHRASES, key=len, reverse=True)])

    def step(acc, x):
        hits = (F.char_length(acc["text"]) - F.char_length(F.replace(acc["text"], x["p"], F.lit("")))) / F.char_length(x["p"])
        return F.struct(F.replace(acc["text"], x["p"], x["r"]).alias("text"), (acc["score"] + hits * x["w"]).alias("score"))

    return F.aggregate(table, F.struct(text.alias("text"), F.lit(0.0).alias("score")), step)


def tokens(text: Column) -> Column:
    """Devanagari runs, ASCII words and single marks; other characters are dropped."""
    return F.regexp_extract_all(text, F.lit(r"[ऀ-ॿ]+|[a-zA-Z0-9]+|[^\p{L}\p{N}_\s]"), 0)


def scan(toks: Column) -> Column:
    """struct(out, score, skip) of the token scan."""
    lists = {k: F.array(*map(F.lit, v)) for k, v in (("neg", NEGATIONS), ("res", RESOLUTIONS))}
    good = F.create_map(*[x for k, (w, r) in GOOD.items() for x in (F.lit(k), F.struct(F.lit(w).alias("w"), F.lit(r).alias("r")))])
    bad = F.create_map(*[x for k, (w, r) in BAD.items() for x in (F.lit(k), F.struct(F.lit(w).alias("w"), F.lit(r).alias("r")))])
    at = lambda i: F.coalesce(F.get(toks, i), F.lit(""))
    within = lambda name, t: F.array_contains(lists[name], t)
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0.0).alias("score"), F.lit(False).alias("skip"))

    def step(acc, i):
        tok, before, after = at(i), at(i - 1), at(i + 1)
        negated = within("neg", before) | within("neg", after)
        resolved = negated | within("res", before) | within("res", after)
        g, b = F.element_at(good, tok), F.element_at(bad, tok)
        word = (
            F.when(g.isNotNull(), F.when(negated, F.concat(F.lit("not_"), g["r"], F.lit(" terrible bad"))).otherwise(g["r"]))
            .when(b.isNotNull(), F.when(resolved, "fixed resolved clean no bugs").otherwise(b["r"]))
            .when(within("neg", tok), "not")
            .otherwise(tok)
        )
        gain = F.when(g.isNotNull(), F.when(negated, -2.0).otherwise(g["w"])).when(b.isNotNull(), F.when(resolved, 1.8).otherwise(b["w"])).otherwise(0.0)
        skip = (g.isNotNull() & within("neg", after)) | (g.isNull() & b.isNotNull() & (within("neg", after) | within("res", after)))
        done = F.struct(F.array_append(acc["out"], word).alias("out"), (acc["score"] + gain).alias("score"), skip.alias("skip"))
        return F.when(acc["skip"], F.struct(acc["out"].alias("out"), acc["score"].alias("score"), F.lit(False).alias("skip"))).otherwise(done)

    return F.aggregate(F.sequence(F.lit(0), F.size(toks) - 1), start, step)


def normalised(df, text: str, out: str = "text", score: str = "indic_polarity"):
    """``df`` with the rewritten text and its polarity; texts without Devanagari stay and score 0."""
    t = F.coalesce(F.col(text), F.lit(""))
    indic = t.rlike("[ऀ-ॿ]")
    x = df.withColumn("_p", F.when(indic, phrases(t))).withColumn("_t", tokens(F.col("_p.text"))).withColumn("_s", F.when(F.size("_t") > 0, scan(F.col("_t"))))
    x = x.withColumn("_new", F.when(indic, F.array_join(F.coalesce("_s.out", F.array().cast("array<string>")), " ")).otherwise(t)).withColumn("_score", F.when(indic, F.col("_p.score") + F.coalesce("_s.score", F.lit(0.0))).otherwise(0.0))
    return x.withColumn(out, F.col("_new")).withColumn(score, F.col("_score")).drop("_p", "_t", "_s", "_new", "_score")
