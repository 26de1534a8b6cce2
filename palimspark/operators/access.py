"""Row-level access: who may see which chunk, decided before ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the domain.
SHARED_TENANT = "corp-default"
LEVELS = {"public": 0, "internal": 1, "confidential": 2, "restricted": 3, "secret": 4}
OPEN_AUDIENCES = ["all", "any", "everyone"]
ROLE_TAGS = {
    "support": ["support", "support_agent", "team_lead", "support_tl", "employee", "success"],
    "qa": ["qa", "quality_assurance", "security_engineer", "kb_admin"],
}


def level_rank(level: Column) -> Column:
    """A missing level is public, an unknown one internal."""
    name = F.lower(F.trim(level))
    ranked = F.coalesce(*(F.when(name == k, F.lit(v)) for k, v in LEVELS.items()))
    return F.when(level.isNull() | (name == ""), 0).otherwise(F.coalesce(ranked, F.lit(1)))


def audience_tags(audience: Column) -> Column:
    parts = F.split(F.translate(F.coalesce(audience, F.lit("")), "，", ","), ",", -1)
    return F.array_distinct(F.filter(F.transform(parts, lambda t: F.lower(F.trim(t))), lambda t: t != ""))


def expanded_roles(roles: Column) -> Column:
    """The roles and the audience tags that they stand for."""
    own = F.transform(roles, lambda r: F.lower(F.trim(r)))
    more = F.concat(*(F.when(F.array_contains(own, r), F.array(*map(F.lit, tags))).otherwise(F.array().cast("array<string>")) for r, tags in ROLE_TAGS.items()))
    return F.array_distinct(F.concat(own, more))


def may_access(tenant: Column, level: Column, audience: Column, user_tenant: Column, clearance: Column, roles: Column) -> Column:
    """Tenant, clearance and audience, as one boolean Column."""
    chunk, user = F.trim(F.coalesce(tenant, F.lit(""))), F.trim(F.coalesce(user_tenant, F.lit("")))
    same_tenant = (chunk == "") | F.when(user == "", chunk == SHARED_TENANT).otherwise(chunk == user)
    cleared = clearance >= level_rank(level)
    open_to_all = (F.coalesce(audience, F.lit("")) == "") | F.lower(F.trim(audience)).isin(OPEN_AUDIENCES)
    meets = (F.size(roles) > 0) & F.arrays_overlap(audience_tags(audience), expanded_roles(roles))
    return same_tenant & cleared & (open_to_all | F.coalesce(meets, F.lit(False)))


ATTRIBUTES = ["tenant_id", "security_level", "audience"]


def class_of(tenant: Column, level: Column, audience: Column) -> Column:
    """Nodes of one class are seen by the same users: a number for their access attributes."""
    return F.xxhash64(*(F.coalesce(c, F.lit("\0")) for c in (tenant, level, audience)))


def with_class(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("cls", class_of(*map(F.col, ATTRIBUTES)))


def classes_for(nodes: DataFrame, users: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, classes): the classes of nodes that each user may see. Users meet classes, not nodes."""
    kinds = with_class(nodes.select(*ATTRIBUTES).distinct())
    allowed = may_access(*map(F.col, ATTRIBUTES), F.col("user_tenant"), F.col("clearance"), F.col("roles"))
    return users.join(kinds, allowed, "left").groupBy(key).agg(F.collect_set("cls").alias("classes"))


def visible(hits: DataFrame, nodes: DataFrame, classes: DataFrame, key: str = "user_id") -> DataFrame:
    """The hits (key, node_id, ...) that the user may see, each judged by its node's class."""
    met = hits.join(with_class(nodes).select("node_id", "cls"), "node_id").join(classes, key)
    return met.filter(F.array_contains("classes", F.col("cls"))).select(hits.columns)


def top_visible(scored: DataFrame, nodes: DataFrame, classes: DataFrame, k: int, key: str = "user_id") -> DataFrame:
    """The k best of (node_id, score) among what each user may see: the best of each class first, then of each user's classes."""
    own = scored.join(with_class(nodes).select("node_id", "cls"), "node_id")
    nth = F.row_number().over(Window.partitionBy("cls").orderBy(F.col("score").desc(), "node_id"))
    heads = own.withColumn("_nth", nth).filter(F.col("_nth") <= k).drop("_nth")
    met = classes.select(key, F.explode("classes").alias("cls")).join(heads, "cls")
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), "node_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(key, "node_id", "score", "rank")


#: Rows that are read one after another and grouped together; those of one class and slab make a slice.
SLAB = 8192


def slices(rows: DataFrame, attributes: list[str], key: str) -> DataFrame:
    """(attributes, _slab, ids): what decides access, once for each slab, with the keys that share it, nulls and repeated ones too."""
    own = rows.withColumn("_slab", F.floor(F.monotonically_increasing_id() / SLAB))
    listed = own.groupBy(*attributes, "_slab").agg(F.collect_list(F.struct(key)).alias("ids"))
    deal = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, since slices are small and what they expand to is not
    return listed.withColumn("ids", F.transform("ids", lambda r: r[key])).repartition(deal)


def allowed_nodes(chunks: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, node_id) of what each user may see.

    Slices of chunks meet slices of users, judged once for all their pairs, and expand in the task that met them, so no pair is
    shuffled. A slice's users repeat for each of its nodes, which a columnar file holds in little.
    """
    allowed = may_access(*map(F.col, ATTRIBUTES), F.col("user_tenant"), F.col("clearance"), F.col("roles"))
    nodes = slices(chunks, ATTRIBUTES, "node_id").select(*ATTRIBUTES, F.col("ids").alias("_nodes"))
    seers = slices(users, ["user_tenant", "clearance", "roles"], "user_id").select("user_tenant", "clearance", "roles", F.col("ids").alias("_users"))
    met = nodes.join(seers, allowed).select("_users", F.explode("_nodes").alias("node_id"))
    return met.select(F.explode("_users").alias("user_id"), "node_id")


def open_to_groups(chunks: DataFrame, users: DataFrame) -> DataFrame:
    """``chunks`` with ``open_to``: the user groups (``grp``) that may see each.

    ``users`` is (grp, user_tenant, clearance, roles), a row for each combination of attributes. Only distinct
    attributes of both sides are judged against each other; no pair of a user and a chunk is made.
    """
    attributes = ATTRIBUTES
    allowed = may_access(F.col("tenant_id"), F.col("security_level"), F.col("audience"), F.col("user_tenant"), F.col("clearance"), F.col("roles"))
    judged = chunks.select(*attributes).distinct().join(users.dropDuplicates(["grp"]), allowed, "left")
    seen = judged.groupBy(*attributes).agg(F.collect_set("grp").alias("open_to")).withColumnsRenamed({a: f"_{a}" for a in attributes})
    return chunks.join(seen, [F.col(a).eqNullSafe(F.col(f"_{a}")) for a in attributes]).drop(*(f"_{a}" for a in attributes))


def keep_allowed(hits: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """Hits (user_id, node_id, ...) that the user may see; without a user context nothing is filtered."""
    return hits if allowed is None else hits.join(allowed, ["user_id", "node_id"], "left_semi")


def in_domains(domain: Column, wanted: list[str], strict: bool = False) -> Column:
    """Rows of the wanted domains; those without a domain too, unless strict."""
    hit = F.lower(domain).isin([w.lower() for w in wanted])
    return F.coalesce(hit, F.lit(False)) if strict else F.coalesce(hit, F.lit(True))
