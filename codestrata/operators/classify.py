"""Classification of matched symbols, descriptions, links and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Kinds of changes, their labels and their order in reports.
LABELS = {
    "Added": "ADD", "Deleted": "DEL", "Renamed": "REN", "Moved": "MOV", "MovedAndModified": "M+M", "Extracted": "EXT",
    "Inlined": "INL", "SignatureChanged": "SIG", "BodyChanged": "MOD", "VisibilityChanged": "VIS",
}
RISKS = {
    "Deleted": ("symbol deleted", "High"), "SignatureChanged": ("signature changed", "High"), "Renamed": ("renamed", "High"), "Moved": ("moved", "Medium"),
    "MovedAndModified": ("moved and modified", "High"), "BodyChanged": ("body modified", "Medium"), "VisibilityChanged": ("visibility changed", "Medium"),
    "Extracted": ("code extracted", "Medium"), "Inlined": ("code inlined", "Medium"), "Added": ("new symbol", "Low"),
}


def one_of(c: Column, values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def change_kind(o: str = "old", n: str = "new") -> Column:
    """The kind of change between two matched symbols (struct columns)."""
    old, new = lambda f: F.col(f"{o}.{f}"), lambda f: F.col(f"{n}.{f}")
    body = old("body_hash") != new("body_hash")
    signature = text.normalized_signature(old("parameters"), old("return_type")) != text.normalized_signature(new("parameters"), new("return_type"))
    return (
        F.when((old("file_path") != new("file_path")) & body, "MovedAndModified")
        .when(old("file_path") != new("file_path"), "Moved")
        .when(old("name") != new("name"), "Renamed")
        .when(signature, "SignatureChanged")
        .when(old("visibility") != new("visibility"), "VisibilityChanged")
        .otherwise("BodyChanged")
    )


def unchanged(o: str = "old", n: str = "new") -> Column:
    """Equal bodies, names and visibilities: no change is reported."""
    return (F.col(f"{o}.body_hash") == F.col(f"{n}.body_hash")) & (F.col(f"{o}.name") == F.col(f"{n}.name")) & F.col(f"{o}.visibility").eqNullSafe(F.col(f"{n}.visibility"))


def signature_delta(old_parameters: Column, new_parameters: Column, old_return: Column, new_return: Column) -> Column:
    """Parameters added and removed by name, whether the common ones changed places, and the return types."""
    names = lambda p: F.transform(p, lambda x: x["name"])
    old, new = names(old_parameters), names(new_parameters)
    common = F.filter(old, lambda x: F.array_contains(new, x))
    moved = F.transform(common, lambda x: F.array_position(old, x)) != F.transform(common, lambda x: F.array_position(new, x))
    return F.struct(
        F.filter(new_parameters, lambda p: ~F.array_contains(old, p["name"])).alias("params_added"),
        F.filter(old_parameters, lambda p: ~F.array_contains(new, p["name"])).alias("params_removed"),
        ((F.size(common) >= 2) & moved).alias("params_reordered"),
        (~old_return.eqNullSafe(new_return)).alias("return_type_changed"),
        old_return.alias("old_return_type"), new_return.alias("new_return_type"),
    )


def delta_text(d: Column) -> Column:
    parts = F.array(
        F.when(F.size(d["params_added"]) > 0, F.format_string("+%dparams", F.size(d["params_added"]))),
        F.when(F.size(d["params_removed"]) > 0, F.format_string("-%dparams", F.size(d["params_removed"]))),
        F.when(d["return_type_changed"], "ret changed"),
    )
    return F.array_join(F.filter(parts, lambda x: x.isNotNull()), ", ")


def symbol_name(old: Column, new: Column) -> Column:
    return F.coalesce(new["name"], old["name"], F.lit("<unknown>"))


def file_info(old: Column, new: Column) -> Column:
    moved = F.concat(old["file_path"], F.lit(" -> "), new["file_path"])
    return F.when(old["file_path"] != new["file_path"], moved).otherwise(F.coalesce(new["file_path"], old["file_path"], F.lit("")))


def description(kind: Column, old: Column, new: Column, delta: Column) -> Column:
    to = lambda f: F.concat(old[f], F.lit(" -> "), new[f])
    return (
        F.when(kind == "Added", "new symbol").when(kind == "Deleted", "removed").when(kind == "Renamed", to("name")).when(kind == "Moved", to("file_path"))
        .when(kind == "MovedAndModified", F.concat(to("file_path"), F.lit(" (modified)")))
        .when(kind == "Extracted", F.concat(F.lit("extracted from "), old["name"], F.lit(" as "), new["name"]))
        .when(kind == "Inlined", F.concat(old["name"], F.lit(" inlined into "), new["name"]))
        .when(kind == "SignatureChanged", delta_text(delta)).when(kind == "VisibilityChanged", to("visibility")).otherwise("body modified")
    )


def risk(kind: Column, old: Column, new: Column) -> tuple[Column, Column]:
    """What a change means for callers: text and level."""
    said = one_of(kind, {k: v[0] for k, v in RISKS.items()})
    detail = F.when(kind == "Renamed", F.concat(F.lit(" "), old["name"], F.lit(" -> "), new["name"])).when(kind.isin("Moved", "MovedAndModified"), F.concat(F.lit(" "), old["file_path"], F.lit(" -> "), new["file_path"]))
    return F.concat(said, F.coalesce(detail, F.lit(""))), one_of(kind, {k: v[1] for k, v in RISKS.items()})


def related_changes(changes: DataFrame) -> DataFrame:
    """Links each Extracted change to the first other change of its source: id, related_id, both ways.

    changes: id, kind, old_name."""
    extracted = changes.where("kind = 'Extracted'").select(F.col("id").alias("x"), F.col("old_name").alias("source"))
    first = changes.select(F.col("id").alias("y"), F.col("old_name").alias("source"))
    # the least and second least id of each name are enough: the first that isn't the change itself
    low = first.groupBy("source").agg(F.min("y").alias("y1"))
    second = first.join(low, "source").where("y <> y1").groupBy("source").agg(F.min("y").alias("y2"))
    pair = extracted.join(low, "source").join(second, "source", "left").select("x", F.when(F.col("x") == F.col("y1"), F.col("y2")).otherwise(F.col("y1")).alias("y")).where("y IS NOT NULL")
    return pair.select(F.col("x").alias("id"), F.col("y").alias("related_id")).unionByName(pair.select(F.col("y").alias("id"), F.col("x").alias("related_id")))


def summary(changes: DataFrame) -> DataFrame:
    """One row of counts by kind; moves count with or without a change, modified holds changed bodies and visibilities."""
    n = lambda *k: F.count_if(F.col("kind").isin(*k))
    return changes.agg(
        F.count("*").alias("total_changes"), n("Added").alias("added"), n("Deleted").alias("deleted"), n("BodyChanged", "VisibilityChanged").alias("modified"), n("Renamed").alias("renamed"),
        n("Moved", "MovedAndModified").alias("moved"), n("Extracted").alias("extracted"), n("Inlined").alias("inlined"), n("SignatureChanged").alias("signature_changed"),
    )
