"""Identity, group roles and envelopes as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import role_map

#: Codes of identities and group roles.
IDENTITIES = {1: "STUDENT", 2: "TEACHER", 3: "ADMIN"}
GROUP_ROLES = {0: "OWNER", 1: "ADMIN", 2: "MEMBER", -1: "NOT_MEMBER"}


def named(code: Column, names: dict[int, str]) -> Column:
    """The code's name; null for an unknown or null code."""
    return F.element_at(F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))]), code.cast("int")) if names else F.lit(None)


def group_role(roles: Column, group: Column) -> Column:
    """The role's code; a group that is not in the map is -1."""
    return F.coalesce(F.try_element_at(roles, group), F.lit(-1))


def checked(requests: DataFrame, identities: tuple[int, ...], roles: tuple[int, ...]) -> DataFrame:
    """Requests (user_id, identity, group_id, role_json) with what they may do.
    A role map with any unknown code counts as unset."""
    parsed = role_map(F.col("role_json"))
    known = F.when(F.forall(F.map_values(parsed), lambda c: c.isin(list(GROUP_ROLES))), parsed)
    role = group_role(known, F.col("group_id"))
    return requests.select(
        "*",
        F.coalesce(named(F.col("identity"), IDENTITIES), F.lit("")).alias("identity_name"),
        named(role, GROUP_ROLES).alias("group_role"),
        (F.col("user_id").isNotNull() & F.col("identity").isin(list(identities)) & role.isin(list(roles))).alias("allowed"),
    )
