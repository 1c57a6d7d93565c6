"""Schemas, and discovery of what a profile table's columns are."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

PROFILE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "name", "core_skills", "secondary_skills", "soft_skills", "skill_summary", "potential_roles")]
    + [T.StructField("years_of_experience", T.DoubleType())]
)
EDGES = "edge_id string, type string, src string, dst string"
NODES = "label string, key string, name string"

#: Words in a column's name that tell its kind, tried in this order.
KINDS = {
    "numeric": ("year", "experience", "salary", "age", "duration"),
    "summary": ("summary", "description", "about", "bio", "profile"),
    "skill": ("skill", "competenc", "technolog", "tool", "knowledge"),
    "role": ("role", "title", "position", "job", "career"),
}


@dataclass
class Fields:
    key: str | None = None
    name: str | None = None
    numeric: list[str] = field(default_factory=list)
    summary: list[str] = field(default_factory=list)
    skill: list[str] = field(default_factory=list)
    role: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)


def discover(schema: T.StructType) -> Fields:
    """Kinds by type and name, at plan time; no job runs. Exact id and name first, then numbers, summaries, skills, roles, text."""
    out = Fields()
    for f in schema.fields:
        low = f.name.lower()
        if low == "id":
            out.key = f.name
        elif low == "name":
            out.name = f.name
        else:
            kind = next((k for k, words in KINDS.items() if any(w in low for w in words) or k == "numeric" and isinstance(f.dataType, T.NumericType)), "text")
            getattr(out, kind).append(f.name)
    return out
