"""Vocabularies, line ranges and sentences."""

from pyspark.sql import functions as F

from factgraph.operators import normalise


def test_terms_come_to_the_vocabulary(spark):
    cases = {"Health Data, PII,contact-information, pii": ["health_data", "user_identity_direct", "contact_information"], "unheard of, e-mail": ["other"], " , !!": None, "Phi,phi": ["health_data"], None: None}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").orderBy("i")
    got = df.select("i", normalise.to_vocabulary(normalise.listed(F.col("t")), normalise.CATEGORIES, normalise.CATEGORY_ALIASES).alias("x"), normalise.to_vocabulary(normalise.listed(F.col("t")), ["phi"], {}, None).alias("y")).collect()
    assert [r["x"] for r in got] == list(cases.values()) and got[3]["y"] == ["phi"] and got[0]["y"] is None
    assert df.limit(1).select(normalise.to_vocabulary(F.array(F.lit("Legal basis"), F.lit("storage")), normalise.PURPOSES, normalise.PURPOSE_ALIASES)).first()[0] == ["legal_compliance", "data_storage"]
    clouds = spark.createDataFrame([(["Google Cloud", "amazon"],), (["x"],), (["microsoft-azure"],), (None,)], "s array<string>").select(normalise.cloud_provider(F.col("s")))
    assert [r[0] for r in clouds.collect()] == ["AWS", None, "Azure", None]


def test_ranges_stay_in_the_excerpt(spark):
    df = spark.createDataFrame([(5, 9), (1, 2), (90, 99), (8, 3)], "s int, e int").select(normalise.clamped(F.col("s"), F.col("e"), F.lit(4), F.lit(12)).alias("x"))
    assert [tuple(r["x"]) for r in df.collect()] == [(5, 9), (4, 4), (12, 12), (8, 8)]


def test_sentences(spark):
    schema = "seq int, pattern string, framework string, client string, database string, service string, source_context string"
    findings = [
        (1, "express_route", "nextjs", None, None, None, None), (2, "express_route", "Next", None, None, None, None), (3, "express_route", "express", None, None, None, "dependency_manifest"), (4, "express_route", " ", None, None, None, None), (5, "express_route", "my_router", None, None, None, None),
        (6, "database_connection", None, "pg", "postgres", None, None), (7, "database_connection", None, None, None, None, None), (8, "database_connection", None, "pg", "postgres", None, None), (9, "external_api_call", None, None, None, "Google_identity", None), (10, "external_api_call", None, None, None, "STRIPE", None),
    ]
    components = spark.createDataFrame([("third_party", "stripe"), ("third_party", "Auth0"), ("asset", "x"), ("third_party", None)], "type string, service string")
    got = [(r["part"], r["at"], r["line"]) for r in normalise.sentences(spark.createDataFrame(findings, schema), components).orderBy("part", "at").collect()]
    assert got == [
        ("outbound", 1, "Calls out to Auth0, Google Identity, and Stripe"), ("routes", 1, "Found 1 Framework route"), ("routes", 2, "Found 1 My router route"), ("routes", 3, "Found 2 Next.js routes"), ("stores", 1, "Talks to Postgres (pg)"), ("stores", 2, "Talks to SQL (Database)"),
    ]
    one = normalise.sentences(spark.createDataFrame([], schema), components.filter("service = 'stripe'")).collect()
    assert [r["line"] for r in one] == ["Calls out to Stripe"]
