"""Schemas of the engine's tables."""

from pyspark.sql import types as T

S, D, I, B = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()
STRINGS = T.ArrayType(S)

CORPUS = T.StructType([T.StructField(n, t) for n, t in [
    ("row_idx", T.LongType()), ("source", S), ("subject", S), ("body", S), ("sender", S),
    ("recipient", S), ("urls", S), ("label", I)]])

RESULT = T.StructType([
    T.StructField("error", S), T.StructField("prediction", S), T.StructField("classification", S),
    T.StructField("spam_risk", D), T.StructField("confidence", D), T.StructField("overall_risk", D),
    T.StructField("risk_level", S), T.StructField("domain_category", S), T.StructField("reasons", STRINGS),
    T.StructField("url_analysis", T.StructType([
        T.StructField("urls_detected", I), T.StructField("suspicious_urls", I),
        T.StructField("items", T.ArrayType(T.StructType([
            T.StructField("url", S), T.StructField("domain", S), T.StructField("https", B)]))),
        T.StructField("reputation", S)])),
    T.StructField("context_analysis", T.StructType([
        T.StructField("score", D), T.StructField("level", S), T.StructField("indicators", STRINGS)])),
    T.StructField("sender_analysis", T.StructType([
        T.StructField("sender", S), T.StructField("domain", S), T.StructField("score", D),
        T.StructField("verification", S), T.StructField("indicators", STRINGS)])),
    T.StructField("explanation", S),
])

HISTORY = T.StructType([
    T.StructField("id", S), T.StructField("sender", S), T.StructField("recipient", S),
    T.StructField("subject", S), T.StructField("body", S), T.StructField("classification", S),
    T.StructField("spam_risk", D), T.StructField("confidence", D), T.StructField("overall_risk", D),
    T.StructField("reasons", STRINGS), T.StructField("features", RESULT), T.StructField("created_at", T.TimestampType()),
])

# The exchange form: the two nested columns as JSON text.
HISTORY_WIRE = T.StructType([f if f.name not in ("reasons", "features") else T.StructField(f.name, S)
                             for f in HISTORY.fields])
