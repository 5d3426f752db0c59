"""Classification of tool calls as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The risk of each known tool; one role includes all others.
RISK = {"read_file": "read", "list_dir": "read", "write_file": "write", "shell": "high"}
ADMIN = "admin"


def risk(tool: Column) -> Column:
    """Empty for an unknown tool."""
    known = F.create_map(*[F.lit(x) for pair in RISK.items() for x in pair])
    return F.coalesce(F.try_element_at(known, tool), F.lit(""))


def is_known(tool: Column) -> Column:
    return F.coalesce(tool.isin(*RISK), F.lit(False))


def needs_approval(tool: Column, shell: bool = True, write: bool = True) -> Column:
    """High-risk tools and writes as configured; unknown tools always."""
    r = risk(tool)
    return (r == "") | ((r == "high") & F.lit(shell)) | ((r == "write") & F.lit(write))


def allowed(tool: Column, allow: list[str]) -> Column:
    return tool.isin(*allow) if allow else F.lit(False)


def has_role(role: Column, wanted: list[str]) -> Column:
    return (role == ADMIN) | role.isin(*wanted)
