"""Column functions: names, sizes, durations, progress, configuration."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_of(content: Column) -> Column:
    """Bytes as UTF-8, invalid ones replaced, line ends as in Python's text mode."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")


def module_name(path: Column) -> Column:
    """Path parts, the last one without its suffix, joined by dots."""
    parts = F.split(F.regexp_replace(F.translate(path, "\\", "/"), "/+$", ""), "/")
    last = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    head = F.slice(parts, 1, F.size(parts) - 1)
    return F.concat_ws(".", F.filter(F.concat(head, F.array(last)), lambda p: ~p.isin("", ".", "..")))


def basename(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "/+$", ""), "^.*/", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(?<=.)(\.[^.]*)$", 1))


def format_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB, with one decimal above B, rounded as C's and Python's %.1f do.

    The decimal is that of the quotient as a double, exactly, and of two equally near the even one. Java's
    formatter rounds the shortest text of the double instead, and 0.25 up, so whole numbers are used here.
    """
    exact = n.cast("double").cast("long")  # what is left of n in a double; dividing it by a power of two loses nothing

    def scaled(power: int, unit: str) -> Column:
        size = F.lit(1024**power).cast("long")
        whole, rest = F.call_function("div", exact, size), exact % size * 10
        tenth, over = F.call_function("div", rest, size), rest % size * 2
        tenths = whole * 10 + tenth + ((over > size) | ((over == size) & (tenth % 2 == 1))).cast("long")
        return F.concat(F.call_function("div", tenths, F.lit(10).cast("long")).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(unit))

    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).when(n < 1024**2, scaled(1, "KB"))
        .when(n < 1024**3, scaled(2, "MB")).otherwise(scaled(3, "GB"))
    )


def format_duration(seconds: Column) -> Column:
    """Whole seconds as 5s, 2m05s or 1h02m."""
    s = seconds.cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    minutes, hours = F.floor(s / 60), F.floor(s / 3600)
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(minutes.cast("string"), F.lit("m"), two(s % 60), F.lit("s")))
        .otherwise(F.concat(hours.cast("string"), F.lit("h"), two(F.floor((s % 3600) / 60)), F.lit("m")))
    )


def progress(done: Column, total: Column) -> Column:
    return F.floor(done * 100 / total).cast("long")


def eta(elapsed: Column, done: Column, total: Column) -> Column:
    return elapsed / done * (total - done)


# States in the order shown, with their names.
STATES = {"PENDING": "pendientes", "PROCESSING": "procesando", "PROCESSED": "indexados", "FAILED": "fallidos"}


def status_line(counts: Column, busy: Column) -> Column:
    """A map of counts by state, known states first, and whether the pipeline is busy, as one line."""
    known = F.array(*[F.lit(k) for k in STATES])
    names = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    order = F.concat(F.filter(known, lambda k: F.map_contains_key(counts, k)), F.array_except(F.map_keys(counts), known))
    shown = F.transform(order, lambda k: F.concat(F.coalesce(names[k], F.lower(k)), F.lit("="), counts[k].cast("string")))
    state = F.when(busy, F.lit("pipeline=ocupado")).when(~busy, F.lit("pipeline=inactivo"))
    parts = F.concat(F.coalesce(shown, F.array().cast("array<string>")), F.array_compact(F.array(state)))
    return F.when(F.size(parts) > 0, F.array_join(parts, "  ")).otherwise("(el servidor no expone estado de indexado)")


# Storage classes (key-value, vector, graph, document status) of each known profile.
PROFILES = {
    "filesystem": ("JsonKVStorage", "NanoVectorDBStorage", "NetworkXStorage", "JsonDocStatusStorage"),
    "postgres": ("PGKVStorage", "PGVectorStorage", "PGGraphStorage", "PGDocStatusStorage"),
    "neo4j": ("JsonKVStorage", "NanoVectorDBStorage", "Neo4JStorage", "JsonDocStatusStorage"),
    "hibrido": ("PGKVStorage", "PGVectorStorage", "Neo4JStorage", "PGDocStatusStorage"),
}
STORAGES = ("kv", "vector", "graph", "doc_status")


def storage_profile() -> Column:
    """The profile of the columns kv, vector, graph, doc_status; a null is the file system's class."""
    own = [F.coalesce(F.col(c), F.lit(d)) for c, d in zip(STORAGES, PROFILES["filesystem"])]
    out = F
    for name, classes in PROFILES.items():
        same = own[0] == classes[0]
        for column, value in zip(own[1:], classes[1:]):
            same = same & (column == value)
        out = out.when(same, name)
    return out.otherwise("mixed")


def storage_problems() -> Column:
    """Codes of what is wrong, or worth a warning, with a storage configuration, in order."""
    missing = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    graph = F.coalesce(F.col("graph") == "Neo4JStorage", F.lit(False))
    tables = F.exists(F.array(*STORAGES), lambda c: F.coalesce(c.startswith("PG"), F.lit(False)))
    checks = {
        "error: graph without uri": graph & missing("graph_uri"), "error: graph without password": graph & missing("graph_password"),
        "error: tables without host": tables & missing("table_host"), "error: tables without password": tables & missing("table_password"),
        "warning: mixed profile": storage_profile() == "mixed", "warning: reindex after a change": storage_profile() != "filesystem",
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in checks.items()]))


def first_truthy(*columns: Column) -> Column:
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def mode_or_default(mode: Column, modes: tuple[str, ...], default: str, last: str = "mix") -> Column:
    """The mode if there is such a one, else the default, or ``last`` if that is none either."""
    return F.when(mode.isin(*modes), mode).otherwise(default if default in modes else last)


# What a message of success contains.
ACCEPTED = ("sin duplicar", "aceptado")


def accepted(message: Column) -> Column:
    """Whether an answer says that a document was taken; a missing answer doesn't."""
    return F.coalesce(message.contains(ACCEPTED[0]) | message.contains(ACCEPTED[1]), F.lit(False))


def storage_entries(health: Column) -> Column:
    """Map of lower-case name to text of all scalar fields of a health text whose name contains "storage".

    They are looked for under "configuration" if that is an object, else at the root; a text that is
    no object gives an empty map.
    """
    fields = lambda text: F.from_json(text, "map<string,string>")
    root = F.coalesce(fields(health), F.create_map().cast("map<string,string>"))
    inner = root["configuration"]
    entries = F.map_entries(F.when(inner.startswith("{"), fields(inner)).otherwise(root))
    own = F.filter(entries, lambda e: F.contains(F.lower(e["key"]), F.lit("storage")) & e["value"].isNotNull() & ~e["value"].rlike(r"^[\[{]"))
    return F.map_from_entries(F.transform(own, lambda e: F.struct(F.lower(e["key"]), e["value"])))
