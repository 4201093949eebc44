"""Column expressions over file names and paths; no Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..formats.fixed import ARCHIVE_SUFFIXES, PLAIN_SUFFIXES
from ..formats.registry import HANDLER_OF, MIME_OF, OTHER


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def directory(path: Column) -> Column:
    """What stands before the last slash; empty without one."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def mime_type(name: Column) -> Column:
    """By the last extension of the file name, which must follow something."""
    ext = F.lower(F.regexp_extract(file_name(name), r"^.+\.([^.]*)$", 1))
    return F.coalesce(F.try_element_at(_map(MIME_OF), ext), F.lit(OTHER))


def handler(mime: Column) -> Column:
    return F.try_element_at(_map(HANDLER_OF), mime)


def archive_format(name: Column) -> Column:
    """Format by suffix, longest first; ``plain <kind>`` for compressed files that are no archives, else ``unknown``."""
    lower, out = F.lower(name), None
    for suffix in sorted(ARCHIVE_SUFFIXES, key=len, reverse=True):
        out = (F if out is None else out).when(lower.endswith(suffix), ARCHIVE_SUFFIXES[suffix])
    for suffix, kind in PLAIN_SUFFIXES.items():
        out = out.when(lower.endswith(suffix), f"plain {kind}")
    return out.otherwise("unknown")


def simplified_directory(path: Column, home: Column) -> Column:
    """The parent directory with the home folder shortened to a tilde at a component border."""
    d = directory(path)
    return F.when(d == home, "~").when(F.startswith(d, F.concat(home, F.lit("/"))), F.concat(F.lit("~"), F.substr(d, F.length(home) + 1))).otherwise(d)


def traverses(name: Column) -> Column:
    return F.array_contains(F.split(name, r"[/\\]"), "..")


def normalized_path(path: Column) -> Column:
    """Without empty and dot parts; .. takes a part away, at the root it stays there."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    empty = F.array().cast("array<string>")
    step = lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, empty, step), "/")


def rels_base(rels: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(rels, r"(^|/)_rels/[^/]*$", "$1"), "/$", "")


def rels_target(rels: Column, target: Column) -> Column:
    full = F.when(F.startswith(target, F.lit("/")), target).when(target.isNotNull(), F.concat_ws("/", rels_base(rels), target))
    return normalized_path(full)


def format_bytes(n: Column) -> Column:
    """IEC units, one floored decimal, none if it is 0; KiB are whole."""
    def unit(shift: int, label: str) -> Column:
        tenths = F.floor(n * 10 / F.lit(1 << shift)) if shift < 40 else F.expr("0L")
        whole, rest = F.floor(tenths / 10), tenths % 10
        return F.concat(whole.cast("string"), F.when(rest == 0, "").otherwise(F.concat(F.lit("."), rest.cast("string"))), F.lit(f" {label}"))

    return F.when(n >= 1 << 30, unit(30, "GiB")).when(n >= 1 << 20, unit(20, "MiB")).when(n >= 1 << 10, F.concat(F.floor(n / 1024).cast("string"), F.lit(" KiB"))).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def over_cap(n: Column, cap: int | None) -> Column:
    return F.lit(False) if cap is None else n > cap
