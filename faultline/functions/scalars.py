"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fragments of names of environment variables that look secret.
SECRET = ["KEY", "TOKEN", "SECRET", "PASSWORD", "PASSWD", "PWD", "CREDENTIAL", "CRED", "AUTH", "PRIVATE", "SESSION", "COOKIE", "SIGNATURE", "CERT", "SALT", "BEARER", "ACCESS", "APIKEY", "LICENSE"]
#: Code fence languages by extension.
FENCES = {"py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "ts": "typescript", "tsx": "tsx", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "scala": "scala", "json": "json", "sh": "bash", "toml": "toml", "yaml": "yaml", "yml": "yaml"}
#: Language tags of stack lines.
TAGS = {"node": " (node)", "rust": " (rust)", "go": " (go)", "jvm": " (jvm)"}
#: Reasons by rank.
REASONS = {1: "stack trace", 2: "failing test", 3: "imported by, or in the same package as, a relevant file", 4: "in git diff", 5: "dependency manifest"}
MAX_OUTPUT = 20_000
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]"


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body's lambdas use it."""
    return F.get(F.transform(F.array(value), body), 0)


def tokens(text: Column) -> Column:
    """Estimated tokens: a quarter of the characters, rounded up."""
    return F.floor((F.length(text) + 3) / 4).cast("long")


def byte_tokens(size: Column) -> Column:
    return F.floor((size + 3) / 4).cast("long")


def reduction_percent(packet: Column, repository: Column) -> Column:
    return F.when(repository > 0, F.greatest(F.lit(0.0), (1 - packet / repository) * 100)).otherwise(0.0)


def report(packet: Column, repository: Column) -> Column:
    """Three lines with thousands separators and one decimal."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Repository source: "), F.format_number(repository, 0), F.lit(" tokens (estimated)")),
        F.concat(F.lit("Packet: "), F.format_number(packet, 0), F.lit(" tokens (estimated)")),
        F.concat(F.lit("Context reduction: "), F.format_string("%.1f", reduction_percent(packet, repository)), F.lit("%")),
    )


def safe_names(env: Column) -> Column:
    """Sorted names of a map's variables, without those that look secret; never a value."""
    return F.array_sort(F.filter(F.map_keys(env), lambda k: ~k.rlike("(?i)" + "|".join(SECRET))))


def is_secret(name: Column) -> Column:
    return name.rlike("(?i)" + "|".join(SECRET))


def lines(text: Column) -> Column:
    """Lines as Python's splitlines gives them."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def capped(text: Column, limit: int = MAX_OUTPUT, mark: str = "\n... [truncated]") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


def without_end(text: Column) -> Column:
    """The text without the line feeds at its end; a pattern, which looks at each line's end, only where another line break follows them."""
    short = F.rtrim(text, F.lit("\n"))
    return F.when(F.right(short, F.lit(1)).isin("\r", "\u0085", "\u2028", "\u2029"), F.regexp_replace(text, "\n+$", "")).otherwise(short)


def shell_join(command: Column) -> Column:
    """POSIX-quoted words of a command."""
    quoted = F.transform(command, lambda w: F.when(w.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$"), w).otherwise(F.concat(F.lit("'"), F.replace(w, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))))
    return F.array_join(quoted, " ")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def fence(path: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(FENCES), extension(path)), F.lit(""))


def some(names: Column, limit: int) -> Column:
    """The first names and how many more there are."""
    return F.concat(F.array_join(F.slice(names, 1, limit), ", "), F.when(F.size(names) > limit, F.concat(F.lit(", and "), F.size(names) - limit, F.lit(" more"))).otherwise(""))


def porcelain(status: Column) -> Column:
    """Paths named by `git status --porcelain` lines."""
    long = F.filter(F.split(status, "\n"), lambda x: F.length(x) > 3)
    return F.transform(long, lambda x: F.regexp_replace(F.trim(F.substring(x, 4, 1_000_000)), '^"|"$', ""))


def changed_files(diff_names: Column, status: Column) -> Column:
    """Sorted union of the files that the diff and the status name."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.filter(F.array_union(F.coalesce(diff_names, empty), F.coalesce(porcelain(status), empty)), lambda x: x != ""))


def utc_second(ts: Column) -> Column:
    """A timestamp's second in UTC, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def tidy(segments: Column) -> Column:
    """A path from segments, with each `..` taken back; null where that leaves the repository."""

    def step(held, x):
        up = F.when(F.size(held) > 0, F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0))))
        return F.when(held.isNull(), held).when(x == "..", up).otherwise(F.concat(held, F.array(x)))

    return F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/")


def parts(path: Column) -> Column:
    """Segments of a path: backslashes folded, empty and `.` ones dropped."""
    return F.filter(F.split(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin("", "."))
