"""Loading and exporting records as JSON lines.

Nodes are ``{"type": T, "data": {..}}``, edges ``{"edge": E, "from": key, "to": key, "data": {..}}``. Blank lines, ``//``
lines and other objects are skipped. Lines are parsed once to VARIANT on the JVM; every check is an expression, and a
load fails with the first messages before anything is written.
"""

from __future__ import annotations

import os
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.errors import ConstraintError, LoadError
from graphloom.functions.embedding import embed_cached
from graphloom.functions.vector import embed_texts
from graphloom.plans.schema import EdgeType, NodeType, Prop
from graphloom.plans.types import INTEGERS, PropType
from graphloom.sources.media import import_media
from graphloom.sources.store import Store, Version, number
from graphloom.util import materialize

MODES = ("overwrite", "append", "merge")


def lines(store: Store, path: str | None = None, text: str | None = None) -> DataFrame:
    """One row per record: line, v (the record), type, edge."""
    spark = store.spark
    raw = spark.read.text(path) if path is not None else spark.createDataFrame([(x,) for x in text.splitlines()], "value string").coalesce(1)
    raw = raw.withColumn("line", F.monotonically_increasing_id())
    raw = raw.filter(~F.trim("value").startswith("//") & (F.trim("value") != ""))
    v = raw.withColumn("v", F.try_parse_json("value"))
    get = lambda p: F.try_variant_get("v", p, "string")
    bad = F.when(F.col("v").isNull(), F.substring("value", 1, 120)).alias("bad")
    # Lines are parsed once; every table is made from what is kept here.
    return materialize(v.select("line", "v", get("$.type").alias("type"), get("$.edge").alias("edge"), bad))


def _scalar(v: str, t: PropType) -> tuple[Column, Column]:
    """(value, fits) of a JSON scalar; ``v`` is the name of its variant column."""
    kind = F.schema_of_variant(v)
    text, s = F.try_variant_get(v, "$", "string"), t.scalar
    whole = kind.isin("BIGINT") | (kind.startswith("DECIMAL") & kind.endswith(",0)"))
    if s == "String":
        fits = kind == "STRING"
        return text, fits & text.isin(*t.enum) if t.enum else fits
    if s == "Bool":
        return F.try_variant_get(v, "$", "boolean"), kind == "BOOLEAN"
    if s in INTEGERS:
        low, high = INTEGERS[s]
        exact = F.try_variant_get(v, "$", "decimal(38,0)")
        return exact.try_cast(t.spark()), whole & exact.between(F.lit(Decimal(low)), F.lit(Decimal(high)))
    if s in ("F32", "F64"):
        return F.try_variant_get(v, "$", "double").cast(t.spark()), whole | kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    n = F.try_variant_get(v, "$", "bigint")
    if s == "Date":
        value = F.when(kind == "STRING", text.try_cast("timestamp").cast("date")).when(whole, F.date_add(F.lit("1970-01-01").cast("date"), n.cast("int")))
    else:
        ms = F.date_trunc("MILLISECOND", text.try_cast("timestamp"))
        value = F.when(kind == "STRING", ms).when(whole, F.timestamp_millis(n)).cast("timestamp_ntz")
    return value, value.isNotNull()


def _prop(p: Prop, filled: bool = False) -> tuple[Column, Column]:
    """(value, message or null) of a property; reads the variant column ``p:<name>``."""
    v, t = f"`p:{p.name}`", p.type
    kind = F.schema_of_variant(F.col(v))
    absent = F.col(v).isNull() | (kind == "VOID")
    if t.vector:
        value = F.try_variant_get(v, "$", "array<float>")
        fits = kind.startswith("ARRAY<") & (F.size(value) == t.dim) & ~F.exists(value, lambda x: x.isNull())
    elif t.list:
        inner = t.spark().elementType.simpleString()
        items = F.try_variant_get(v, "$", "array<string>")
        if t.scalar == "DateTime":
            value = F.transform(items, lambda x: F.date_trunc("MILLISECOND", x.try_cast("timestamp")).cast("timestamp_ntz"))
        elif t.scalar == "Date":
            value = F.transform(items, lambda x: x.try_cast("timestamp").cast("date"))
        else:
            value = F.try_variant_get(v, "$", f"array<{inner}>")
        want = {"String": "ARRAY<STRING>", "Bool": "ARRAY<BOOLEAN>"}.get(t.scalar)
        typed = kind.isin(want, "ARRAY<VOID>") if want else kind.startswith("ARRAY<") & ((kind != "ARRAY<STRING>") | F.lit(t.scalar in ("Date", "DateTime")))
        fits = typed & value.isNotNull() & ~F.exists(F.arrays_zip(items.alias("a"), value.alias("b")), lambda x: x["a"].isNotNull() & x["b"].isNull())
    else:
        value, fits = _scalar(v, t)
    value = F.when(~absent, value).cast(t.spark())
    missing = F.lit(None).cast("string") if t.nullable or p.embed or filled else F.when(absent, F.lit(f"{p.name} is missing"))
    wrong = F.when(~absent & ~F.coalesce(fits, F.lit(False)), F.concat(F.lit(f"{p.name}: "), F.to_json(F.col(v)), F.lit(f" doesn't fit {t}")))
    return value, F.coalesce(missing, wrong)


def _typed(rows: DataFrame, own: NodeType | EdgeType, extra: list[Column]) -> DataFrame:
    """The records of one type with typed properties, and ``_bad``: what doesn't fit."""
    props = list(own.props.values())
    data = F.try_variant_get("v", "$.data", "string")
    wide = rows.select("line", *extra, data.alias("_data"), *[F.try_variant_get("v", f"$.data.{p.name}", "variant").alias(f"p:{p.name}") for p in props])
    known = F.array(*[F.lit(p.name) for p in props]) if props else F.array().cast("array<string>")
    unknown = F.array_except(F.json_object_keys("_data"), known)
    msgs = [F.when(F.size(unknown) > 0, F.concat(F.lit("unknown property "), unknown[0]))]
    if isinstance(own, NodeType):
        msgs.append(F.when(F.col("_data").isNull(), F.lit("data is missing")))
    kinds = {p.media for p in props}
    parts = [_prop(p, p.name in kinds) for p in props]
    out = wide.withColumns({p.name: value for p, (value, _) in zip(props, parts, strict=True)} | {"_bad": F.coalesce(*msgs, *[m for _, m in parts], F.lit(None).cast("string"))})
    return out.select("line", *[c for c in out.columns if c.startswith("end:")], *own.props, "_bad")


def _fitting(out: DataFrame, own: NodeType | EdgeType) -> DataFrame:
    """What was made, kept; LoadError names the first records that don't fit."""
    out = materialize(out)
    bad = out.filter("_bad is not null").select("_bad").take(3)
    if bad:
        raise LoadError("; ".join(f"{own.name}: {b[0]}" for b in bad))
    return out.drop("_bad")


def check_unique(df: DataFrame, t: NodeType) -> None:
    for prop in t.unique:
        twice = df.filter(F.col(prop).isNotNull()).groupBy(prop).count().filter("count > 1").take(1)
        if twice:
            raise ConstraintError(f"{t.name}.{prop}: {twice[0][0]!r} stands more than once")


def embed_column(df: DataFrame, source: str, p: Prop, provider, cache: str | None, model: str) -> DataFrame:
    """``df`` with null vectors of ``p`` made from the text in ``source``; with ``cache`` each text is embedded once over all loads."""
    if cache is not None:
        return embed_cached(df, source, p.name, p.type.dim, provider, cache, model)
    made = embed_texts(p.type.dim, provider).asNondeterministic()(F.when(F.col(p.name).isNull(), F.col(source)))
    return df.withColumn(p.name, F.coalesce(p.name, made))


def embed_missing(df: DataFrame, t: NodeType, provider, cache: str | None = None, model: str = "") -> DataFrame:
    """Vectors of @embed properties that are null, from their source text. They are made once, and what reads them reads that."""
    targets = [p for p in t.props.values() if p.embed]
    for p in targets:
        df = embed_column(df, p.embed, p, provider, cache, model)
    if not targets:
        return df
    df = materialize(df)
    for p in targets:
        if not p.type.nullable and df.filter(F.col(p.name).isNull()).take(1):
            raise LoadError(f"{t.name}.{p.name}: no text in {p.embed} to embed")
    return df


def load(store: Store, *, path: str | None = None, text: str | None = None, mode: str | None = None, provider=None, cache: str | None = None, model: str = "") -> Version:
    """Load records in one commit. The mode is merge by default if a type has a @key, else overwrite."""
    from graphloom.functions.vector import mock_embedding

    base = store.version()
    cat = base.catalog
    mode = mode or ("merge" if any(n.key for n in cat.nodes.values()) else "overwrite")
    if mode not in MODES:
        raise LoadError(f"unknown mode {mode}")
    records = lines(store, path, text)
    kinds = records.groupBy("type", "edge").agg(F.min("bad").alias("bad")).collect()
    if broken := [k.bad for k in kinds if k.bad is not None]:
        raise LoadError(f"no JSON: {broken[0]}")
    present = {(k.type, k.edge) for k in kinds}
    for t, e in present:
        if t is not None and t not in cat.nodes:
            raise LoadError(f"unknown node type {t}")
        if t is None and e is not None and cat.edge(e) is None:
            raise LoadError(f"unknown edge type {e}")
    tables: dict[str, list[str]] = {}
    next_node, next_edge = (1, 1) if mode == "overwrite" else (base.next_node, base.next_edge)
    fresh: dict[str, DataFrame] = {}
    replaced: set[str] = set()
    for name, t in cat.nodes.items():
        if (name, None) not in present and not any(x == name for x, _ in present):
            if mode == "overwrite":
                tables[f"node:{name}"] = []
            fresh[name] = store.table(base, f"node:{name}") if mode != "overwrite" else store.spark.createDataFrame([], t.spark())
            continue
        new = _fitting(_typed(records.filter(F.col("type") == name), t, []), t)
        if any(p.media for p in t.props.values()):
            new = materialize(import_media(new, t, store.files.root, os.path.dirname(path) if path else None))
        new = embed_missing(new, t, provider or mock_embedding, cache, model)
        check_unique(new, t)
        ids, n = number(new, next_node, "_new")
        ids, next_node = ids.drop("line"), next_node + n
        cols = ["id", *t.props]
        if mode == "merge" and t.key:
            # Only folders that hold one of the keys are written again.
            kept, hit_paths = store.touched(base, f"node:{name}", ids, [t.key])
            o = store.part(base, f"node:{name}", hit_paths).select(F.col("id").alias("_old"), *[F.col(p).alias(f"o:{p}") for p in t.props])
            j = ids.join(o, F.col(t.key) == F.col(f"o:{t.key}"), "full_outer")
            hit = F.col("_new").isNotNull()
            out = j.select(F.coalesce("_old", "_new").alias("id"), *[F.when(hit, F.col(p)).otherwise(F.col(f"o:{p}")).alias(p) for p in t.props])
        else:
            out = ids.select(F.col("_new").alias("id"), *t.props)
            kept = base.tables.get(f"node:{name}", []) if mode == "append" else []
            if mode == "merge":
                replaced.add(name)
        written = store.write(f"node:{name}", out.select(*cols))
        tables[f"node:{name}"] = [*kept, written]
        whole = store.part(base, f"node:{name}", tables[f"node:{name}"])
        if (kept and mode == "append") or (mode == "merge" and t.key and len(t.unique) > 1):
            check_unique(whole, t)
        fresh[name] = whole
    for name, e in cat.edges.items():
        said = [x for _, x in present if x is not None and cat.edge(x) is e]
        gone = {e.source, e.target} & replaced
        if not said and not gone:
            if mode == "overwrite":
                tables[f"edge:{name}"] = []
            continue
        kept: list[str] = base.tables.get(f"edge:{name}", []) if mode != "overwrite" and not gone else []
        if not said:
            tables[f"edge:{name}"] = kept
            continue
        new = _edges(records.filter(F.col("type").isNull() & F.col("edge").isin(*said)), e, cat, fresh)
        new, n = number(new, next_edge)
        next_edge += n
        if kept:
            # An edge that is there already keeps its id and takes the new properties; only folders with one are written again.
            kept, hit_paths = store.touched(base, f"edge:{name}", new, ["src", "dst"])
            if hit_paths:
                old = store.part(base, f"edge:{name}", hit_paths).withColumn("line", F.lit(-1).cast("bigint"))
                last = F.max_by(F.struct(*e.props), "line").alias("p") if e.props else F.lit(1).alias("p")
                both = new.unionByName(old).groupBy("src", "dst").agg(F.min_by("id", "line").alias("id"), last)
                new = both.select("id", "src", "dst", *[F.col("p")[p].alias(p) for p in e.props])
        tables[f"edge:{name}"] = [*kept, store.write(f"edge:{name}", new.select("id", "src", "dst", *e.props))]
    return store.commit(base, tables, summary=f"load {mode}", next_node=next_node, next_edge=next_edge)


def _edges(rows: DataFrame, e: EdgeType, cat, nodes: dict[str, DataFrame]) -> DataFrame:
    """Edge records with their endpoints' ids; one row per pair, the last line's."""
    ends = {"from": cat.nodes[e.source], "to": cat.nodes[e.target]}
    for t in ends.values():
        if t.key is None:
            raise LoadError(f"{e.name}: {t.name} has no @key to refer to")
    new = _typed(rows, e, [F.try_variant_get("v", f"$.{side}", "string").alias(f"end:{side}") for side in ends])
    for side, t in ends.items():
        keys = nodes[t.name].select(F.col("id").alias(f"_{side}"), F.col(t.key).cast("string").alias("_key"))
        new = new.join(keys, F.col(f"end:{side}") == F.col("_key"), "left").drop("_key")
    last = F.max_by(F.struct(*e.props), "line").alias("p") if e.props else F.lit(1).alias("p")
    lost = F.max(F.when(F.col("_from").isNull() | F.col("_to").isNull(), F.struct(F.col("end:from"), F.col("end:to")))).alias("_lost")
    one = _fitting(new.groupBy(F.col("_from").alias("src"), F.col("_to").alias("dst")).agg(F.max("line").alias("line"), last, lost, F.max("_bad").alias("_bad")), e)
    gap = one.filter("_lost is not null").select("_lost").take(1)
    if gap:
        raise LoadError(f"{e.name}: no such endpoint in {gap[0][0][0]} -> {gap[0][0][1]}")
    return one.select("line", "src", "dst", *[F.col("p")[p].alias(p) for p in e.props])


def export(store: Store, v: Version | None = None, *, embeddings: bool = True, ids: bool = False) -> DataFrame:
    """The graph as JSON lines that load again: one column ``value``, nodes before edges (``part`` orders them)."""
    v = v or store.version()
    out = []
    for name, t in v.catalog.nodes.items():
        props = [p.name for p in t.props.values() if embeddings or not p.type.vector]
        data = F.struct(*([F.col("id")] if ids else []), *props)
        out.append(store.table(v, f"node:{name}").select(F.lit(0).alias("part"), F.lit(name).alias("name"), F.col("id"), F.to_json(F.struct(F.lit(name).alias("type"), data.alias("data"))).alias("value")))
    for name, e in v.catalog.edges.items():
        a, b = v.catalog.nodes[e.source], v.catalog.nodes[e.target]
        src = store.table(v, f"node:{e.source}").select(F.col("id").alias("src"), F.col(a.key or "id").cast("string").alias("from"))
        dst = store.table(v, f"node:{e.target}").select(F.col("id").alias("dst"), F.col(b.key or "id").cast("string").alias("to"))
        rows = store.table(v, f"edge:{name}").join(src, "src").join(dst, "dst")
        fields = [F.lit(name).alias("edge"), F.col("from"), F.col("to")] + ([F.struct(*e.props).alias("data")] if e.props else [])
        out.append(rows.select(F.lit(1).alias("part"), F.lit(name).alias("name"), F.col("id"), F.to_json(F.struct(*fields)).alias("value")))
    return reduce(lambda x, y: x.unionByName(y), out).orderBy("part", "name", "id").select("value")
