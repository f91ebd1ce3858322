"""Column functions that read requests, commands, reports, paths and addresses out of text; all stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, word lists and formats.
DECISION = r"(?im)^(?:decision|decisi[oó]n|chosen approach|enfoque elegido|resoluci[oó]n adoptada)\s*:\s*(.+)$"
COMPLETION = r"(?im)(?:^|\n)\s*(?:done|completed|finished|terminado|completado|finalizado)\b[:\s-]*(.{0,400})"
REALTIME = r"(?i)<realtime_delegation>[\s\S]*?<input>([\s\S]*?)</input>[\s\S]*?</realtime_delegation>"
REQUEST = r"(?i)(?:^|\n)## My request:\s*([\s\S]*)$"
ENVELOPE = r"(?i)^(?:<recommended_plugins>|<environment_context>|<permissions instructions>|<skills_instructions>|<apps_instructions>|<plugins_instructions>|<collaboration_mode>|# Response annotations:)"
TAGS_ONLY = r"(?i)^<[^>]+>\s*(?:<[^>]+>[\s\S]*</[^>]+>\s*)+</[^>]+>$"
VALIDATION = (
    r"(?i)^(?:&\s*)?(?:(?:python|python3|py)\s+(?:-B\s+)?(?:-m\s+(?:pytest|unittest|py_compile)\b|[^\s]*validate[^\s]*\.py\b)|pytest\b|py\.test\b|node\s+(?:--test\b|[^\s]*validate[^\s]*\.m?js\b)"
    r"|npm\s+(?:test\b|run\s+(?:test|check|lint|build)\b)|pnpm\s+(?:test\b|run\s+(?:test|check|lint|build)\b)|yarn\s+(?:test\b|run\s+(?:test|check|lint|build)\b)|cargo\s+test\b|go\s+test\b|dotnet\s+test\b"
    r"|mvnw?\s+test\b|gradlew?\s+test\b|ruff\s+(?:check|format)\b|eslint\b|tsc\s+--noEmit\b|git\s+diff\s+--check\b)"
)
SUFFIXES = r"(?:ments?|ations?|ions?|ing|ed|es|s)$"
KEY_LINES = r"(?i)(?:fail|error|warn|pass|test|build|lint|benchmark|exit|status|created|modified|deleted)"
COMMANDS = r"""\b(?:cmd|command)\s*:\s*("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`)"""
KINDS = {
    "DOCUMENT": ["md", "txt", "docx", "pdf"],
    "CONFIGURATION": ["json", "yaml", "yml", "toml", "ini", "env"],
    "SCHEMA": ["sql", "avsc", "proto"],
    "MEDIA": ["png", "jpg", "jpeg", "gif", "svg", "webp"],
}
UNITS = ["B", "KiB", "MiB", "GiB", "TiB"]
ADDRESS = r"^case://evidence/sha256/([a-f0-9]{64})/record/(\d+)(?:#bytes=(\d+):(\d+))?$"


def _accents() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the letters without."""
    found = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xC0, 0x250)) if c.islower()]
    found = [(c, b) for c, b in found if c != b]
    return "".join(c for c, _ in found), "".join(b for _, b in found)


def terms(text: Column) -> Column:
    """Runs of letters and digits of any script, lower-case and without accents."""
    marked, plain = _accents()
    return F.filter(F.split(F.translate(F.lower(text), marked, plain), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def elided(text: Column, limit: int = 1200) -> Column:
    """The text with LF line ends and no blanks before them; over the limit, seven tenths from its head and the rest
    from its tail, with how much is left out between them."""
    plain = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "[ \t]+\n", "\n")
    head = -(-limit * 7 // 10)
    marker = F.concat(F.lit("\n…["), (F.length(plain) - limit).cast("string"), F.lit(" chars omitted from projection; raw evidence retained]…\n"))
    return F.when(F.length(plain) > limit, F.concat(F.substring(plain, 1, head), marker, F.right(plain, F.lit(limit - head)))).otherwise(plain)


def search_text(text: Column) -> Column:
    """What is embedded: at most 100,000 characters, single blanks, no more than one empty line."""
    return F.trim(F.regexp_replace(F.regexp_replace(elided(text, 100_000), "[ \t]+", " "), "\n{3,}", "\n\n"))


def size_text(n: Column) -> Column:
    """Bytes in the largest unit that leaves at least 1, with a decimal below 10."""
    unit = F.least(F.lit(len(UNITS) - 1), F.greatest(F.lit(0), F.floor(F.log(1024.0, F.greatest(n, F.lit(1)).cast("double")) + 1e-12))).cast("int")
    value = n / F.pow(F.lit(1024.0), unit)
    shown = F.when((value >= 10) | (unit == 0), F.round(value).cast("long").cast("string")).otherwise(F.round(value, 1).cast("string"))
    return F.when(n.isNull(), "unknown").otherwise(F.concat_ws(" ", shown, F.element_at(F.array(*map(F.lit, UNITS)), unit + 1)))


def duration_text(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    return F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), F.floor(s % 3600 / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s"))


def stems(text: Column) -> Column:
    """Distinct stems of four characters or more of tokens of four or more."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_-]{4,}"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda t: F.regexp_replace(t, SUFFIXES, "")), lambda t: F.length(t) >= 4))


def related(left: Column, right: Column) -> Column:
    return F.arrays_overlap(stems(left), stems(right))


def substantive(text: Column) -> Column:
    """A user's own words: out of an envelope or after its request heading; null if nothing of theirs is left."""
    text = F.trim(text)
    inner = F.when(text.rlike(REALTIME), F.trim(F.regexp_extract(text, REALTIME, 1))).otherwise(text)
    asked = F.when(inner.rlike(REQUEST), F.trim(F.regexp_extract(inner, REQUEST, 1))).otherwise(inner)
    noise = asked.rlike(ENVELOPE) | (asked.rlike(TAGS_ONLY) & ~asked.rlike(r"[.!?]\s*$"))
    return F.when((asked != "") & ~noise, asked)


def is_validation(command: Column) -> Column:
    """Whether some part of the command tests, lints or builds."""
    return F.coalesce(F.exists(F.split(command, r"\r?\n|;|&&|\|\|"), lambda x: F.trim(x).rlike(VALIDATION)), F.lit(False))


def compact(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def command_key(session: Column, command: Column) -> Column:
    return F.concat_ws("\0", session, F.lower(compact(F.coalesce(command, F.lit("")))))


def validation_target(command: Column) -> Column:
    return F.concat(F.lit("historical command: "), F.substring(compact(command), 1, 180))


def validation_status(status: Column, exit_code: Column) -> Column:
    by_status = F.when(F.upper(status) == "FAILED", "OBSERVED_FAIL").when(F.upper(status) == "INCOMPLETE", "INCOMPLETE").otherwise("OBSERVED_PASS")
    return F.when(exit_code == 0, "OBSERVED_PASS").when(exit_code.isNotNull(), "OBSERVED_FAIL").otherwise(by_status)


def extension(path: Column) -> Column:
    """The suffix of the last part, lower-case, without its dot; a name that starts with its only dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/\\.][^/\\]*\.([^./\\]*)$", 1))


def artifact_kind(path: Column) -> Column:
    out = F.lit("FILE")
    for kind, suffixes in reversed(KINDS.items()):
        out = F.when(extension(path).isin(suffixes), kind).otherwise(out)
    return out


def stored_suffix(path: Column) -> Column:
    found = extension(path)
    return F.when(found.rlike("^[a-z0-9]{1,8}$"), found).otherwise("txt")


def logical_path(path: Column, root: Column) -> Column:
    """Below the root, the path from there; separators are slashes."""
    plain, base = F.replace(path, F.lit("\\"), F.lit("/")), F.rtrim(F.replace(root, F.lit("\\"), F.lit("/")), F.lit("/"))
    return F.when(base.isNotNull() & plain.startswith(F.concat(base, F.lit("/"))), plain.substr(F.length(base) + 2, F.length(plain))).otherwise(plain)


def extract_command(text: Column) -> Column:
    """The command of a JSON request, else up to 32 quoted literals after `cmd:` or `command:`, in order."""
    value = F.try_parse_json(text)
    direct = F.coalesce(*[F.try_variant_get(value, f"$.{k}", "string") for k in ("cmd", "command", "script")])
    found = F.slice(F.regexp_extract_all(text, F.lit(COMMANDS), F.lit(1)), 1, 32)

    def plain(x: Column) -> Column:
        body = F.substring(x, F.lit(2), F.length(x) - 2)
        quoted = F.get_json_object(F.concat(F.lit('{"x":'), x, F.lit("}")), "$.x")
        other = F.replace(F.replace(F.replace(body, F.lit("\\n"), F.lit("\n")), F.lit("\\'"), F.lit("'")), F.lit("\\`"), F.lit("`"))
        return F.when(x.startswith('"'), F.coalesce(quoted, body)).otherwise(other)

    return F.coalesce(direct, F.when(F.size(found) > 0, F.array_join(F.transform(found, plain), "\n--- nested command ---\n")))


def semantic_extract(output: Column, status: Column, exit_code: Column) -> Column:
    """Status, exit code and the telling lines of an output, or its first and last four: 20 lines, 4,000 characters."""
    lines = F.filter(F.split(output, "\r?\n"), lambda x: F.trim(x) != "")
    telling = F.filter(lines, lambda x: x.rlike(KEY_LINES))
    ends = F.concat(F.slice(lines, 1, 4), F.reverse(F.slice(F.reverse(lines), 1, 4)))
    core = F.slice(F.when(F.size(telling) > 0, telling).otherwise(ends), 1, 20)
    head = F.array(F.concat(F.lit("status="), status), F.concat(F.lit("exit_code="), exit_code.cast("string")))
    return F.substring(F.array_join(F.concat(F.array_compact(head), F.coalesce(core, F.array().cast("array<string>"))), "\n"), 1, 4000)


def decisions(text: Column) -> Column:
    """Texts after a decision mark, one a line."""
    return F.transform(F.regexp_extract_all(text, F.lit(DECISION), F.lit(1)), lambda x: F.trim(x))


def completions(text: Column) -> Column:
    """Texts after a done-word that begins a line."""
    found = F.transform(F.regexp_extract_all(text, F.lit(COMPLETION), F.lit(1)), lambda x: F.trim(x))
    return F.transform(found, lambda x: F.when(x == "", "completion reported").otherwise(x))


def address(uri: Column) -> Column:
    """sha256, ordinal, offset and length of an evidence address, null if it is none."""
    part = lambda n: F.regexp_extract(uri, ADDRESS, n)
    number = lambda n: F.nullif(part(n), F.lit("")).try_cast("long")
    return F.when(uri.rlike(ADDRESS), F.struct(part(1).alias("sha256"), number(2).alias("ordinal"), number(3).alias("offset"), number(4).alias("length")))


def escaped(text: Column) -> Column:
    """For tables of a view: no back ticks, white space as one blank."""
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("`"), F.lit("ˋ")), r"\s+", " ")


def quoted(text: Column, limit: int = 900) -> Column:
    value = F.trim(F.regexp_replace(elided(text, limit), "\n+", " "))
    return F.when(F.coalesce(value, F.lit("")) == "", "(no projected text)").otherwise(F.concat(F.lit("“"), value, F.lit("”")))


def label(event_id: Column) -> Column:
    return F.concat(F.lit("EV-"), F.substring(F.regexp_replace(event_id, "^evt-", ""), 1, 10))


def stable_json(**fields: Column) -> Column:
    """A JSON object with its keys in order, nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def ratio(part: Column, whole: Column, empty: float = 1.0) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)
