"""Erasing accounts: what hangs on them by foreign keys, and the files that these rows name."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Link(NamedTuple):
    """Rows of ``child`` whose ``column`` is ``key`` of an erased row of ``parent`` go with it."""

    parent: str
    key: str
    child: str
    column: str


class Erased(NamedTuple):
    kept: dict[str, DataFrame]
    gone: dict[str, DataFrame]


def ordered(tables: list[str], links: list[Link]) -> list[str]:
    """Tables so that parents stand before children; an error where links go round."""
    left, order = list(tables), []
    while left:
        free = [t for t in left if not any(x.child == t and x.parent in left and x.parent != t for x in links)]
        if not free:
            raise ValueError(f"links go round among {left}")
        order += free
        left = [t for t in left if t not in free]
    return order


def erase_cascade(tables: dict[str, DataFrame], root: str, key: str, ids: DataFrame, links: list[Link]) -> Erased:
    """The rows of ``root`` whose ``key`` is among ``ids`` (a column of that name) and all that hangs on them.

    The frontier of erased keys goes from table to table by semi-joins, in an order that has parents first; a row that
    hangs on several erased rows goes once, a null reference holds on to nothing.
    """
    kept, gone = {}, {}
    for name in ordered(list(tables), links):
        rows, wanted = tables[name], [x for x in links if x.child == name]
        fronts = [(x.column, gone[x.parent].select(F.col(x.key).alias("erased key"))) for x in wanted]
        if name == root:
            fronts.append((key, ids.select(F.col(key).alias("erased key"))))
        by_column: dict[str, DataFrame] = {}
        for column, front in fronts:
            by_column[column] = by_column[column].unionByName(front) if column in by_column else front
        out, parts = rows, []
        for column, front in by_column.items():  # each row meets the first of its columns that erases it
            on = out[column] == front["erased key"]
            parts.append(out.join(front, on, "left_semi"))
            out = out.join(front, on, "left_anti")
        kept[name] = out
        gone[name] = parts[0] if parts else rows.limit(0)
        for part in parts[1:]:
            gone[name] = gone[name].unionByName(part)
    return Erased(kept, gone)


def named_paths(rows: DataFrame, *paths: Column) -> DataFrame:
    """path: all that the given columns (strings or arrays of them) of rows name, with slashes; empty ones are none."""
    whole = lambda c: rows.select(c.alias("c")).schema["c"].dataType.typeName() == "array"
    arrays = [c if whole(c) else F.array(c) for c in paths]
    found = rows.select(F.explode(F.flatten(F.array(*arrays))).alias("path"))
    return found.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path")).where("path <> ''")


def message_paths(messages: DataFrame) -> DataFrame:
    """Files of messages (session_id, metadata): what ``generated_files`` lists, ``attachments`` name, and the session's folder."""
    strings = lambda path: F.from_json(F.get_json_object("metadata", path), "array<string>")
    attached = F.from_json(F.get_json_object("metadata", "$.attachments"), "array<struct<path:string>>")
    return named_paths(messages, F.coalesce(strings("$.generated_files"), F.array()), F.coalesce(F.transform(attached, lambda x: x["path"]), F.array()))


def erased_paths(gone: dict[str, DataFrame]) -> DataFrame:
    """Each path once that erased messages, sessions, documents and generated documents leave behind."""
    folders = gone["sessions"].select(F.concat(F.lit("chat/attachments/"), F.col("id")).alias("path"))
    parts = [
        message_paths(gone["messages"]), folders, named_paths(gone["documents"], F.col("path")), named_paths(gone["generated"], F.col("output_path")),
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.distinct()
