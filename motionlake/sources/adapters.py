"""Motion-shaped views over the driver's tables, with the same rows in Spark and DuckDB.

``VIEWS`` holds one text per view; the few functions that differ between the engines are named in braces. Every view is
free of ties: its orderings end in a primary key. Session time zone UTC on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SPARK = {"us": "unix_micros(cast(ts as timestamp))", "k": "cast(get_json_object(props, '$.k') as int)", "item": "cast(element_at(embedding, cast({0} as int)) as double)", "landmarks": "lateral view explode(sequence(0, 31)) e as j"}
_DUCK = {"us": "epoch_us(ts)", "k": "cast(json_extract_string(props, '$.k') as int)", "item": "cast(embedding[{0}] as double)", "landmarks": "cross join (select unnest(generate_series(0, 31)) as j) e"}

_BOXES = """
        select {clip} as clip_id, cast(floor({us} / 3600000000) - 473352 as int) as frame, user_id as track_id,
               case when event_type in ('view', 'click') then 'ball' when event_type = 'signup' then 'racket' else 'person' end as class,
               (value * 2) % 960 as x, {k} * cast(5.4 as double) as y, 10 + {k} % 7 as w, 20 + {k} % 11 as h, event_id as box_key
        from {events}"""

VIEWS = {
    "sig": """
        select user_id as clip_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as frame,
               ({us} - min({us}) over (partition by user_id)) / cast(1000 as double) as t_ms,
               case when event_type = 'error' then null else value end as x
        from {events}""",
    "pose": """
        select cast(label as int) as clip_id, frame, frame * 1000 / cast(30 as double) as t_ms, cast(j as int) as lm_id,
               0.5 + {item:2*j+1} as x, 0.5 + {item:2*j+2} as y, {item:((2*j+33)%64)+1} as z,
               least(cast(1 as double), greatest(cast(0 as double), 0.6 + 2 * {item:((2*j+40)%64)+1})) as vis
        from (select *, cast(row_number() over (partition by label order by vec_id) - 1 as int) as frame from {embeddings}) b {landmarks}""",
    "boxes": _BOXES.replace("{clip}", "cast(floor(user_id / cast(10 as double)) as int)"),
    # the same boxes in ten clips that grow with the table, for queries on pairs: clips of ten tracks would bound their work
    "crowd": _BOXES.replace("{clip}", "cast(user_id % 10 as int)"),
    "lab": """
        select o_orderkey as clip_id, case o_orderpriority when '1-URGENT' then 'SV' when '2-HIGH' then 'VL' when '3-MEDIUM' then 'FH' when '5-LOW' then 'SL' else 'BH' end as stroke_type,
               case when o_orderkey % 2 = 0 then 30 else 60 end as fps,
               cast(floor(o_totalprice) as bigint) % 90 + 15 as impact_frame,
               cast(floor(o_totalprice) as bigint) % 90 + 15 - 7 - o_custkey % 5 as backswing_frame, o_orderstatus <> 'P' as usable, o_custkey as annotator_id
        from {orders}""",
    "prd": """
        select l_orderkey as clip_id, count(*) > 1 as detected,
               (cast(floor(max(o_totalprice)) as bigint) % 90 + 15) * cast(1000 as double) / max(case when o_orderkey % 2 = 0 then 30 else 60 end)
                 + cast(sum(cast(l_quantity as bigint)) % 100 - 50 as double) as impact_ms,
               cast(sum(cast(l_quantity as bigint)) % 45 as double) as deviation_deg
        from {lineitem} join {orders} on o_orderkey = l_orderkey group by l_orderkey""",
    "strokes": """
        select l_suppkey as session_id,
               cast(row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) as int) as stroke_index,
               case l_partkey % 6 when 0 then 'FH' when 1 then 'BH' when 2 then 'SV' when 3 then 'VL' when 4 then 'SL' else 'RS' end as stroke_type,
               l_returnflag <> 'R' as is_clean, case when l_linenumber = 7 then null else l_quantity end as shoulder_deg,
               cast(0.5 as double) + l_discount * 30 as tempo, l_extendedprice / 100 as recovery_ms, l_quantity / 2 as hip_deg, 80 + l_tax * 500 as contact_cm, l_discount * 300 - 15 as path_deg, 5 + l_discount * 100 as racket_mps,
               case l_linenumber % 3 when 0 then null when 1 then true else false end as split_step, 1 - l_tax * 5 as confidence
        from {lineitem}""",
    "segs": """
        select cast(floor((c_custkey - 1) / 20) as int) as frame, c_custkey as seg_id, cast((c_custkey * 37) % 960 as double) as x1, cast((c_custkey * 91) % 540 as double) as y1,
               cast((c_custkey * 53 + 200) % 960 as double) as x2, cast((c_custkey * 17 + 100) % 540 as double) as y2
        from {customer}""",
    "poses": """
        select cast(floor((p_partkey - 1) / 40) as int) as camera_id, p_partkey as cand_id, cast(0.8 as double) + 1.4 * (p_size / cast(50 as double)) as height_m, 1 + 13 * ((p_partkey % 97) / cast(97 as double)) as distance_m,
               -15 + 40 * ((p_partkey % 41) / cast(41 as double)) as tilt_deg, -20 + 40 * ((p_partkey % 53) / cast(53 as double)) as pan_deg,
               400 + 1800 * ((p_partkey % 89) / cast(89 as double)) as focal_px
        from {part}""",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _fill(text: str, own: dict, table) -> str:
    out = text
    for name in TABLES:
        out = out.replace("{" + name + "}", table(name))
    while "{item:" in out:
        at = out.index("{item:")
        end = out.index("}", at)
        out = out[:at] + own["item"].replace("{0}", out[at + 6 : end]) + out[end + 1 :]
    for name in ("us", "k", "landmarks"):
        out = out.replace("{" + name + "}", own[name])
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The adapter view ``name`` over the tables in ``sf_dir``."""
    return spark.sql(_fill(VIEWS[name], _SPARK, lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))


def duck(*names: str, **renamed: str) -> str:
    """``with`` clause that defines the views for DuckDB; ``boxes="crowd"`` gives the view ``crowd`` the name ``boxes``."""
    return "with " + ", ".join(f"{n} as ({_fill(VIEWS[v], _DUCK, lambda t: t)})" for n, v in ({n: n for n in names} | renamed).items())
