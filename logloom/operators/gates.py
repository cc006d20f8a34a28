"""Gates: what evidence allows, as predicates, and checks of arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What each target needs.
POLICY = {"issue": "always", "pr": "verified"}
PACKAGE = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"
VERSION = r"^[A-Za-z0-9][A-Za-z0-9.+!_-]*$"
DOTTED = r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*$"
NODE_ID = r"^[A-Za-z0-9_./\-\[\]:=+ ]+$"


def can_act(verified: Column) -> Column:
    """Whether a verification is there and positive."""
    return F.coalesce(verified, F.lit(False))


def required(target: Column) -> Column:
    """What a target needs; an unknown target is an error."""
    out = F.raise_error(F.concat(F.lit("unknown target: "), target)).cast("string")
    for name, need in POLICY.items():
        out = F.when(target == name, F.lit(need)).otherwise(out)
    return out


def tools(verified: Column) -> Column:
    """Names of tools that are within reach: issues always, pull requests for verified fixes."""
    return F.when(can_act(verified), F.array(F.lit("issue"), F.lit("pr"))).otherwise(F.array(F.lit("issue")))


def safe(value: Column, pattern: str) -> Column:
    """Whether a whole value is of an allowed form; null isn't."""
    return F.coalesce(value.rlike(pattern), F.lit(False))


def problems(arguments: dict, schema: dict) -> list[str]:
    """What is wrong with arguments: required, unexpected, type, minimum and maximum. A boolean is no integer."""
    kinds = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}
    known = schema.get("properties", {})
    out = [f"{k}: missing" for k in schema.get("required", []) if k not in arguments]
    for k, v in arguments.items():
        if k not in known:
            out.append(f"{k}: unexpected")
            continue
        rule = known[k]
        kind = rule.get("type")
        if kind and (not isinstance(v, kinds[kind]) or (isinstance(v, bool) and kind in ("integer", "number"))):
            out.append(f"{k}: not {kind}")
        elif ("minimum" in rule and v < rule["minimum"]) or ("maximum" in rule and v > rule["maximum"]):
            out.append(f"{k}: out of range")
    return out


def approvable(missions: DataFrame) -> DataFrame:
    """Adds approvable: a pending approval of the mission's own sandbox, reproduced (exit 1) and verified (exit 0)."""
    ok = (F.col("approval") == "pending") & (F.col("sandbox_id") == F.col("approval_sandbox_id")) & (F.col("red_exit") == 1) & (F.col("green_exit") == 0)
    return missions.withColumn("approvable", F.coalesce(ok, F.lit(False)))
