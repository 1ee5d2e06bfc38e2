"""Scalar functions over columns. All but ``slug_base`` and ``first_json_object`` are built-in expressions; a null gives null."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Longest slug, in characters.
MAX_SLUG = 80


def collapsed_name(name: Column) -> Column:
    """Lower-cased, trimmed, white space runs as one space."""
    return F.regexp_replace(F.lower(F.trim(name)), r"\s+", " ")


def compact_name(name: Column) -> Column:
    """Lower-cased, without white space, underscores and hyphens."""
    return F.regexp_replace(F.lower(name), r"[\s_-]+", "")


def posix_path(path: Column) -> Column:
    """Slashes for backslashes, no leading ./ and no repeated slashes."""
    return F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), "/{2,}", "/"), r"^(\./)+", "")


def dirname(path: Column) -> Column:
    """The path up to its last slash; empty for a bare name."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    """What follows the last slash."""
    return F.regexp_extract(path, r"([^/]*)$", 1)


def without_index(path: Column) -> Column:
    """The path without a last segment index.<extension>."""
    return F.regexp_replace(path, r"/index\.[A-Za-z0-9]+$", "")


def ancestors(path: Column) -> Column:
    """All folders above a path, nearest last, without the root."""
    parts = F.split(path, "/")
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i > 0), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def path_suffixes(path: Column) -> Column:
    """A path and what is left of it after each slash, longest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def resolve_relative(folder: Column, reference: Column) -> Column:
    """A relative reference seen from a folder: . and .. are followed; .. above the root is dropped."""
    segments = F.split(F.concat_ws("/", folder, reference), "/")
    up = F.aggregate(segments, F.array().cast("array<string>"), lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(s.isin("", "."), done).otherwise(F.concat(done, F.array(s))))
    return F.array_join(up, "/")


def container_key(raw: Column) -> Column:
    """Letters, digits, _ and - only; not empty, not starting with a digit. "element" and "n_" are fixed values."""
    clean = F.regexp_replace(raw, "[^A-Za-z0-9_-]", "_")
    return F.when(clean == "", "element").when(clean.rlike("^[0-9]"), F.concat(F.lit("n_"), clean)).otherwise(clean)


def http_urls(line: Column) -> Column:
    """All http and https URLs of a line: the characters that RFC 3986 allows, less quotes and closing brackets, which rather
    end a URL in code, and without full stops or commas at the end."""
    allowed = r"[A-Za-z0-9._~:/?#\[@!$&(*+,;=%-]"
    return F.transform(F.regexp_extract_all(line, F.lit(f"(https?://{allowed}+)"), F.lit(1)), lambda u: F.regexp_replace(u, "[.,;:!]+$", ""))


#: Words that name no vendor. Own choice.
STOP_WORDS = ["api", "app", "client", "cloud", "com", "http", "https", "inc", "io", "ltd", "sdk", "service", "services", "the", "www"]


def vendor_tokens(name: Column) -> Column:
    """Distinct alphanumeric tokens of three characters or more, lower-cased and without STOP_WORDS, and the whole name
    without other characters, if it has five or more."""
    low = F.lower(name)
    compact = F.regexp_replace(low, "[^a-z0-9]+", "")
    tokens = F.filter(F.split(low, "[^a-z0-9]+"), lambda t: (F.length(t) >= 3) & ~t.isin(STOP_WORDS))
    return F.array_distinct(F.concat(tokens, F.when((F.length(compact) >= 5) & ~compact.isin(STOP_WORDS), F.array(compact)).otherwise(F.array().cast("array<string>"))))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up; 0 for null."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def band(score: Column) -> Column:
    """high from 0.85, medium from 0.65, else low."""
    return F.when(score >= 0.85, "high").when(score >= 0.65, "medium").otherwise("low")


def joined_names(names: Column) -> Column:
    """A list as text: A; A and B; A, B, and C; empty for none."""
    n = F.size(names)
    return (
        F.when(n == 0, "").when(n == 1, F.get(names, F.lit(0))).when(n == 2, F.array_join(names, " and "))
        .otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), F.get(names, n - 1)))
    )


def dependency_names(package_json: Column) -> Column:
    """Sorted names under dependencies and devDependencies; none for malformed JSON."""
    both = F.from_json(package_json, "dependencies map<string,string>, devDependencies map<string,string>")
    keys = [F.coalesce(F.map_keys(both[c]), F.array().cast("array<string>")) for c in ("dependencies", "devDependencies")]
    return F.array_sort(F.array_distinct(F.concat(*keys)))


@F.pandas_udf(StringType())
def slug_base(names: pd.Series) -> pd.Series:
    """A file-safe slug: compatibility decomposition, marks dropped, lower-cased, other characters as single hyphens, no
    hyphen or dot at the ends, at most MAX_SLUG characters; ``item`` if nothing is left (also for null)."""
    def one(name: str | None) -> str:
        plain = "".join(c for c in unicodedata.normalize("NFKD", name or "") if not unicodedata.category(c).startswith("M")).lower()
        cut = re.sub(r"-{2,}", "-", re.sub(r"[^a-z0-9._-]+", "-", plain).strip("-."))[:MAX_SLUG]
        return cut.rstrip("-.") or "item"

    return names.map(one)


@F.pandas_udf(StringType())
def first_json_object(texts: pd.Series) -> pd.Series:
    """The JSON of a text that may have a code fence or other words around it: the whole text if it parses, else its first
    balanced object; null if neither parses. The decoder stops at the object's end, so each text is read once."""
    decoder = json.JSONDecoder()

    def one(text: str | None) -> str | None:
        bare = (text or "").strip()
        fence = re.match(r"(?is)```(?:json)?\s*(.*?)```$", bare)
        bare = (fence[1] if fence else bare).strip().removeprefix("\ufeff")
        try:
            json.loads(bare)
            return bare
        except ValueError:
            at = bare.find("{")
        try:
            return bare[at : decoder.raw_decode(bare, at)[1]] if at >= 0 else None
        except ValueError:
            return None

    return texts.map(one)


def entity_uri(kind: Column, identity: Column) -> Column:
    """``dp:`` kind ``/`` identity, the identity percent-encoded."""
    return F.concat(F.lit("dp:"), kind, F.lit("/"), F.replace(F.url_encode(identity), F.lit("+"), F.lit("%20")))


def entity_of(uri: Column) -> Column:
    """(kind, identity) of such a URI; null for other texts."""
    kind, rest = F.regexp_extract(uri, "^dp:([a-z0-9_]+)/(.+)$", 1), F.regexp_extract(uri, "^dp:([a-z0-9_]+)/(.+)$", 2)
    return F.when(kind != "", F.struct(kind.alias("kind"), F.try_url_decode(rest).alias("identity")))


def epoch_seconds(iso: Column) -> Column:
    """Seconds since 1970 of an ISO time; null if it's none."""
    return F.unix_seconds(F.try_to_timestamp(iso))


def land_date(seconds: Column) -> Column:
    """``YYYYMMDD`` of seconds since 1970, in the session's time zone (UTC)."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyyMMdd")


def title_case(name: Column) -> Column:
    """Words between spaces, hyphens and underscores, each with a capital."""
    return F.initcap(F.trim(F.regexp_replace(name, r"[\s_-]+", " ")))


def is_public_url(text: Column) -> Column:
    """An http or https URL that names a real destination: no template, environment variable or this machine."""
    return text.rlike(r"(?i)^https?://") & ~text.rlike(r"(?i)\$\{|process\.env|localhost|127\.0\.0\.1")


def git_remote(remote: Column) -> Column:
    """host/path of a git remote, of URLs and of user@host:path alike, without user, port and .git."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(remote), r"\.git/?$", ""), "^[a-z+]+://", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, "^[^@/]*@", ""), "^([^/:]+):(?:[0-9]+/)?", "$1/"))


def imports_of(source: Column) -> Column:
    """Modules that a source text imports or requires, once each, in order."""
    return F.array_distinct(F.regexp_extract_all(source, F.lit(r"(?:\bfrom\s+|\bimport\s+|\b(?:require|import)\s*\(\s*)['\"]([^'\"]+)['\"]"), F.lit(1)))


def redacted(text: Column) -> Column:
    """The text with values of keys that name secrets, and tokens after Bearer, replaced."""
    keyed = F.regexp_replace(text, r"(?i)((?:api[_-]?key|token|secret|password)[\"']?\s*[:=]\s*[\"']?)[^\s\"',;}]+", "$1[redacted]")
    return F.regexp_replace(keyed, r"(?i)(bearer\s+)[A-Za-z0-9._~+/=-]+", "$1[redacted]")


def normal_token(raw: Column, joiner: str = "_") -> Column:
    """Lower-case, other characters than letters and digits as one joiner, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.trim(raw)), "[^a-z0-9]+", joiner), F.lit(joiner))
