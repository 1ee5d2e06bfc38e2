"""Terms of proposals brought to vocabularies, line ranges to excerpts, and findings to sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Categories of data and purposes of processing, and other names for them. Fixed values.
CATEGORIES = (
    "personal_identifiers contact_information financial_information health_data biometric_data location_data behavioral_data employment_data education_data special_category_data criminal_records demographic_data online_identifiers device_identifiers usage_data aggregated_analytics"
    " financial_data geolocation_gps geolocation_ip photos_selfies professional_data sensitive_personal_data special_categories user_identity_direct user_identity_indirect other"
).split()
CATEGORY_ALIASES = {
    "personal_data": "user_identity_direct", "pii": "user_identity_direct", "personally_identifiable_information": "user_identity_direct", "document_files": "other", "document_metadata": "other", "file_content": "other", "file_metadata": "other",
    "email_address": "contact_information", "credit_card_data": "financial_data", "payment_data": "financial_data", "phi": "health_data", "ip_address": "geolocation_ip", "device_id": "device_identifiers",
}
PURPOSES = (
    "authentication service_provision customer_support payment_processing fraud_prevention analytics marketing advertising development_testing debugging security_monitoring compliance audit data_migration backup_recovery research infrastructure_management hosting_services data_storage"
    " email_delivery security user_insights performance_monitoring customer_management sales_automation legal_compliance transactional_emails marketing_communications backup_services disaster_recovery other"
).split()
PURPOSE_ALIASES = {"legal": "legal_compliance", "legal_basis": "legal_compliance", "provisioning": "service_provision", "document_processing": "service_provision", "storage": "data_storage", "backup": "backup_services"}
#: Services that name a cloud provider. Fixed values.
CLOUDS = {"AWS": ("aws", "amazon", "amazon_web_services"), "GCP": ("gcp", "google", "google_cloud"), "Azure": ("azure", "microsoft_azure")}
#: How frameworks, clients, databases and vendors are written, by their lower-case names. Fixed values.
FRAMEWORKS = {"express": "Express", "nest": "Nest", "nextjs": "Next.js", "next": "Next.js", "next.js": "Next.js", "next_or_react_route": "Next.js", "fastapi": "FastAPI", "flask": "Flask", "django": "Django"}
CLIENTS = {"typeorm": "TypeORM", "prisma": "Prisma", "mongoose": "Mongoose", "psycopg2": "psycopg", "psycopg": "psycopg", "pg": "pg", "knex": "Knex"}
DATABASES = {"postgres": "Postgres", "postgresql": "Postgres", "mysql": "MySQL", "mongodb": "MongoDB", "mongo": "MongoDB", "sqlite": "SQLite", "redis": "Redis", "sql": "SQL"}
VENDORS = {"stripe": "Stripe", "sendgrid": "Sendgrid", "sentry": "Sentry", "openai": "OpenAI", "aws": "AWS", "auth0": "Auth0"}


def token(value: Column) -> Column:
    """Trimmed, lower-case, blanks and hyphens as one underscore, nothing but letters a-z, digits and underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), r"[\s-]+", "_"), "[^a-z0-9_]", "")


def listed(text: Column) -> Column:
    """The trimmed parts of a text between commas that aren't empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda v: F.trim(v)), lambda v: v != "")


def _lookup(value: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, v))), value)


def to_vocabulary(values: Column, allowed: list[str], aliases: dict[str, str], other: str | None = "other") -> Column:
    """An array of terms as words of a vocabulary, each once, in the order in which they come: a token that is one, else what it is an alias of, else ``other`` (dropped if None or no word itself). Null if nothing is left."""
    words = F.array(*map(F.lit, allowed))
    tokens = F.filter(F.transform(values, token), lambda t: t != "")
    mapped = F.transform(tokens, lambda t: F.when(F.array_contains(words, t), t).otherwise(F.coalesce(_lookup(t, aliases), F.lit(other).cast("string"))))
    kept = F.array_distinct(F.filter(mapped, lambda t: t.isNotNull() & F.array_contains(words, t)))
    return F.when(F.size(kept) > 0, kept)


def cloud_provider(services: Column) -> Column:
    """The provider that an array of cloud services names, AWS before GCP before Azure; null for none."""
    tokens = F.transform(services, token)
    return F.coalesce(*(F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, names))), F.lit(p)) for p, names in CLOUDS.items()))


def clamped(start: Column, end: Column, first: Column, last: Column) -> Column:
    """A struct of start and end within the lines of an excerpt, the end not before the start."""
    low = F.greatest(first, F.least(start, last))
    return F.struct(low.alias("start"), F.greatest(low, F.least(end, last)).alias("end"))


def capitalised(word: Column) -> Column:
    """The first letter in upper case; words of up to four characters that are in upper case already stay."""
    return F.when((word == F.upper(word)) & (F.length(word) <= 4), word).otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 20)))


def _called(value: Column, table: dict[str, str]) -> Column:
    return F.coalesce(_lookup(F.lower(value), table), capitalised(value))


def sentences(findings: DataFrame, components: DataFrame) -> DataFrame:
    """part, at, line: what is told of findings (seq, pattern, framework, client, database, service, source_context) and components (type, service). Routes are counted by framework, without those that a dependency manifest only hints at; each pair of client and database is named
    once, in order of its first finding; all vendors of third parties and calls make one sentence, sorted by their lower-case names."""
    def text(column: str) -> Column:
        return F.nullif(F.trim(F.col(column)), F.lit(""))

    routes = findings.filter((F.col("pattern") == "express_route") & (F.coalesce("source_context", F.lit("")) != "dependency_manifest")).withColumn("f", F.coalesce(text("framework"), F.lit("framework")))
    routes = routes.groupBy(F.coalesce(_lookup(F.lower("f"), FRAMEWORKS), capitalised(F.replace("f", F.lit("_"), F.lit(" ")))).alias("name")).agg(F.count("*").alias("n"))
    told = routes.select(F.lit("routes").alias("part"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("name")).alias("at"), F.when(F.col("n") == 1, F.concat(F.lit("Found 1 "), "name", F.lit(" route"))).otherwise(F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(" "), "name", F.lit(" routes"))).alias("line"))
    stores = findings.filter("pattern = 'database_connection'").select("seq", F.coalesce(text("client"), F.lit("database")).alias("c"), F.coalesce(text("database"), F.lit("SQL")).alias("d")).groupBy("c", "d").agg(F.min("seq").alias("seq"))
    told = told.unionByName(stores.select(F.lit("stores").alias("part"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("seq")).alias("at"), F.concat(F.lit("Talks to "), _called(F.col("d"), DATABASES), F.lit(" ("), _called(F.col("c"), CLIENTS), F.lit(")")).alias("line")))
    names = components.filter("type = 'third_party'").select(F.lower(text("service")).alias("v")).unionByName(findings.filter("pattern = 'external_api_call'").select(F.lower(text("service")).alias("v"))).filter("v is not null").distinct()
    words = F.array_join(F.transform(F.filter(F.split("v", r"[_\s]+"), lambda w: w != ""), capitalised), " ")
    all_ = names.groupBy().agg(F.array_sort(F.collect_list(F.struct("v", F.coalesce(_lookup(F.col("v"), VENDORS), words).alias("name")))).getField("name").alias("names")).filter(F.size("names") > 0)
    n = F.size("names")
    joined = F.when(n == 1, F.get("names", F.lit(0))).when(n == 2, F.array_join("names", " and ")).otherwise(F.concat(F.array_join(F.slice("names", F.lit(1), n - 1), ", "), F.lit(", and "), F.get("names", n - 1)))
    return told.unionByName(all_.select(F.lit("outbound").alias("part"), F.lit(1).alias("at"), F.concat(F.lit("Calls out to "), joined).alias("line")))
