"""Column functions on text, ids and times; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
TOKEN_CHARS = 4


def stable_id(prefix: str, n: int, *cols: Column) -> Column:
    """prefix and the first n hex digits of the SHA-256 of the values, joined by |; a null is the empty string."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, n))


def sha256(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / TOKEN_CHARS).cast("long")


def slug(text: Column, limit: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9._-]+", "-"), "^-+|-+$", ""), 1, limit)


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts)


def precision(ts: Column) -> Column:
    return F.when(ts.isNull(), "UNKNOWN").when(F.unix_micros(ts) % 1_000_000 != 0, "MILLISECOND").otherwise("SECOND")


def cosine(a: Column, b: Column) -> Column:
    """Of arrays of numbers, in doubles."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def moment(v: Column) -> Column:
    """A variant as a time: numbers are seconds, above 1e10 milliseconds; strings are read as ISO times."""
    kind, n = F.coalesce(F.schema_of_variant(v), F.lit("")), F.try_variant_get(v, "$", "double")
    number = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.timestamp_seconds(F.when(n > 1e10, n / 1000).otherwise(n)))
    return F.coalesce(number, F.when(kind == "STRING", F.try_to_timestamp(F.try_variant_get(v, "$", "string"))))


def thread_ids(json: Column) -> Column:
    """Distinct ids that are whole strings of the JSON, at any depth and in JSON within strings; keys are none."""
    found = F.regexp_extract_all(json, F.lit(r'(?i)"([0-9a-f]{8}-[0-9a-f-]{27})\\*"(?!\s*:)'), F.lit(1))
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


# Kinds of secrets and their patterns, in the order they are taken out.
SECRETS = [
    ("private-key", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"),
    ("github-token", r"\b(?:gh[pousr]_[A-Za-z0-9_]{20,}|github_pat_[A-Za-z0-9_]{20,})\b"),
    ("openai-key", r"\bsk-[A-Za-z0-9_-]{20,}\b"),
    ("aws-access-key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b"),
]
# Assignments of credentials, and what is no value of one.
ASSIGNMENT = r"""(?i)\b(password|passwd|secret|api[_-]?key|access[_-]?token|auth[_-]?token)\s*([:=])\s*(["']?)([^\s,"']{8,})"""
NO_VALUE = r"(?i)^(?:null|none|undefined|unknown|unavailable|redacted|placeholder|example|changeme|not[-_]?set)$"
REFERENCE = r"(?i)^(?:\$\{|\$env:|%[A-Z0-9_]+%|process\.env\.|os\.environ|env\(|getenv\()"
TYPE_NAME = r"^[A-Z][A-Za-z0-9_.<>\[\]|]*$"
SECRET_TYPE_NAME = r"^(?:Secret|Password|Token|Credential|ApiKey)[A-Za-z0-9_.<>\[\]|]*$"
CREDENTIAL = "credential-assignment"


def credible(found: Column) -> Column:
    """Whether an assignment that matches ASSIGNMENT names a value rather than a placeholder, a reference or a type."""
    part = lambda n: F.regexp_extract(found, ASSIGNMENT, n)
    value, bare = F.regexp_replace(part(4), r"[);}\]]+$", ""), part(3) == ""
    return (value != "") & ~value.rlike(NO_VALUE) & ~value.rlike(REFERENCE) & ~(bare & (part(2) == ":") & value.rlike(TYPE_NAME)) & ~(bare & value.rlike(SECRET_TYPE_NAME))


def _replaced(text: Column, kind: str, pattern: str) -> Column:
    """Every match is replaced by its kind and the first digits of its hash; the text between matches stays."""
    token = lambda m: F.concat(F.lit(f"[REDACTED:{kind}:"), F.substring(F.sha2(m, 256), 1, 8), F.lit("]"))
    swap = lambda m: F.when(credible(m), token(m)).otherwise(m) if kind == CREDENTIAL else token(m)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(F.split(text, pattern, -1), found, lambda p, m: F.concat(p, F.coalesce(swap(m), F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)


def redacted(rows: DataFrame, text: str) -> DataFrame:
    """rows with their text's secrets replaced and `findings`, (kind, fingerprint) of each by kind and place. Each
    kind is sought in what the kinds before it left."""
    findings = []
    for kind, pattern in [*SECRETS, (CREDENTIAL, ASSIGNMENT)]:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        kept = F.filter(found, credible) if kind == CREDENTIAL else found
        name = f"__found_{len(findings)}"
        rows = rows.withColumn(name, F.transform(kept, lambda m: F.struct(F.lit(kind).alias("kind"), F.substring(F.sha2(m, 256), 1, 12).alias("fingerprint"))))  # noqa: B023
        rows, findings = rows.withColumn(text, _replaced(F.col(text), kind, pattern)), [*findings, name]
    return rows.withColumn("findings", F.concat(*findings)).drop(*findings)
