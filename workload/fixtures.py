"""Engine inputs derived from the test tables; the rules are in FIXTURES.md.

Each builder is a plain projection of a whole table, so the work of every query grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# physical schemas of the test tables in use, so that no job has to look them up
SCHEMAS = {
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "orders": """o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz,
        o_orderpriority string""",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def _count(spark: SparkSession, sf: str, name: str):
    return table(spark, sf, name).agg(F.count(F.lit(1))).scalar()


def mapping(spark: SparkSession, sf: str) -> DataFrame:
    """F1."""
    main = """
        s_suppkey as row_seq,
        concat('VP_BANK.v_', s_suppkey, if(s_suppkey % 4 = 1, concat('/VP_BANK.w_', s_suppkey), ''),
               if(s_suppkey % 10 = 8, concat('/orphan_', s_suppkey), '')) as view_id,
        concat('db', s_suppkey % 3) as db_id,
        concat('t_', s_suppkey) as table_id,
        if(s_suppkey % 5 = 4, 'v', '') as year_ind,
        if(s_suppkey % 5 in (1, 2), 'v', '') as month_ind,
        if(s_suppkey % 5 in (2, 3), 'v', '') as day_ind,
        if(s_suppkey % 5 = 0, 'v', '') as ref_ind,
        if(s_suppkey % 5 = 0, '', 'yyyymm') as partition_id,
        if(s_suppkey % 10 = 7, 'v', '') as disabled_ind"""
    extra = """
        100000 + s_suppkey as row_seq, concat('VP_BANK.v_', s_suppkey) as view_id,
        concat('db', s_suppkey % 3) as db_id, concat('t_', s_suppkey) as table_id,
        '' as year_ind, 'v' as month_ind, '' as day_ind, '' as ref_ind, 'yyyymm' as partition_id,
        '' as disabled_ind"""
    unused = """
        200000 + s_suppkey as row_seq, concat('VP_BANK.u_', s_suppkey) as view_id,
        concat('db', s_suppkey % 3) as db_id, concat('u_', s_suppkey) as table_id,
        '' as year_ind, 'v' as month_ind, '' as day_ind, '' as ref_ind, 'yyyymm' as partition_id,
        '' as disabled_ind"""
    return spark.sql(
        f"select {main} from {{s}} union all select {extra} from {{s}} where s_suppkey % 10 = 3 "
        f"union all select {unused} from {{s}} where s_suppkey % 20 = 0",
        s=table(spark, sf, "supplier"),
    )


def stored_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """F2 as stored: arrays may be absent. ``row_seq`` is the store order."""
    part = table(spark, sf, "part").withColumn("n", _count(spark, sf, "supplier"))
    return spark.sql("""
        select p_partkey as row_seq,
            concat('TAG_', p_partkey) as tag_id,
            p_brand as source_type, p_type as source_item,
            if(p_partkey % 17 = 0, null, array(named_struct('type_L1', p_brand, 'type_L2', p_type))) as tag_type,
            p_name as tag_name,
            concat(
                if(p_partkey % 11 = 0, 'select 1', concat(
                    'select c from VP_BANK.v_', p_partkey % n, ' a join vp_bank.',
                    if(p_partkey % 13 = 0, 'w', 'v'), '_', (p_partkey * 7 + 3) % n, ' b on a.k=b.k')),
                if(p_partkey % 4 <> 0 or p_partkey % 40 = 0,
                   ' where d between ''$start_date'' and ''$end_date''', '')) as sql,
            case when p_partkey % 3 = 0 then 'M' when p_partkey % 50 = 1 then 'd' else 'D' end as update_frequency,
            if(p_partkey % 4 = 0, null, cast(-(1 + p_partkey % 6) as int)) as started,
            if(p_partkey % 4 = 0, null, cast(1 + p_partkey % 5 % 3 as int)) as traced,
            p_name as description, '2018-01-01' as create_time, '2018-09-22' as update_time,
            if(p_partkey % 5 = 0, null, p_partkey % 7 = 0) as disable_flag,
            if(p_partkey % 2 = 0, 'sum', 'count') as score_method,
            p_type as attribute, 'fixture' as creator, p_partkey % 9 = 0 as is_focus,
            case p_partkey % 8 when 0 then 'ats' when 1 then 'OTHER' else 'ATS' end as system_name,
            if(p_partkey % 19 = 0, null, array(concat('T', p_partkey))) as tickets
        from {p}""", p=part)


def frontier(spark: SparkSession, sf: str, broken: bool = False) -> DataFrame:
    """F3 in the shape of a message log: topic, JSON value, arrival time, offset. ``broken`` gives F3b."""
    events = table(spark, sf, "events").withColumn("n", _count(spark, sf, "supplier"))
    value = """case when event_id % 101 = 0 then 'not-json'
        when event_id % 103 = 0 then regexp_replace(value, '"partition_values":[^]]*', '"partition_values":[null')
        when event_id % 107 = 0 then regexp_replace(value, '"partition_values":[^]]*', '$0,null') else value end""" if broken else "value"
    return spark.sql(f"""
        select event_id, ts, topic, {value} as value from (
          select event_id, ts,
            if(event_type = 'error', 'hippo-finish', 'frontier-adw') as topic,
            to_json(named_struct(
                'table', case when event_id % 97 = 0 then 't_x' when event_id % 91 = 0 then concat('u_', k)
                    else concat('t_', event_id % n) end,
                'partition_fields', array(if(event_id % n % 5 = 0, '', 'yyyymm')),
                'partition_values', array(if(event_id % n % 5 = 0, '', concat(date_format(add_months(
                    date_add(to_date(ts), -2),
                    case (event_id div n) % 4 when 0 then 0 when 1 then -1 when 2 then -2 else 1 end), 'yyyyMM'),
                    if(event_id % n % 5 = 1 and event_id % 3 = 0, '01', '')))),
                'db', concat('db', if(event_id % 91 = 0, k, event_id % n) % 3),
                'method', event_type,
                'exec_date', cast(floor(unix_micros(cast(ts as timestamp)) / 1000000) as bigint))) as value
          from (select *, event_id % n - event_id % n % 20 as k from {{e}}))""", e=events)


def reports(spark: SparkSession, sf: str) -> DataFrame:
    """F4."""
    orders = table(spark, sf, "orders").withColumn("m", _count(spark, sf, "part"))
    return spark.sql("""
        select concat('TAG_', o_custkey % m) as tag_id, o_orderkey as seq,
            case o_orderstatus when 'O' then 'Start' when 'F' then 'Finish' else 'NonFinish' end as status,
            unix_seconds(cast(o_orderdate as timestamp)) as start_time,
            unix_seconds(cast(o_orderdate as timestamp)) + o_orderkey % 600 as finish_time
        from {o}""", o=orders)


def recent_reports(spark: SparkSession, sf: str) -> DataFrame:
    """F4 with its start times laid over the days of F3, so that runs and messages meet."""
    return reports(spark, sf).withColumn(
        "start_time", F.lit(1704067200) + F.pmod(F.col("start_time") + F.col("seq") * 97, F.lit(30 * 86400))
    ).withColumn("finish_time", F.col("start_time") + F.col("seq") % 600)


def run_reports(spark: SparkSession, sf: str) -> DataFrame:
    """F4 with the execute date that names the run, two days per tag."""
    return reports(spark, sf).withColumn("execute_date", F.when(F.col("seq") % 2 == 0, "1998-09-22").otherwise("1998-09-23"))


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """F5."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("entity_id"),
        F.to_date("o_orderdate").alias("day"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
    )


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """a change feed of write payloads, every field optional; ``target_id`` is the addressed tag."""
    feed = (
        table(spark, sf, "customer")
        .withColumn("n", _count(spark, sf, "supplier")).withColumn("m", _count(spark, sf, "part"))
    )
    return spark.sql("""
        select 1000000000 + c_custkey as row_seq,
            concat('TAG_', (c_custkey * 7) % (m + m div 4)) as target_id,
            if(c_custkey % 29 = 0, null, concat('TAG_', (c_custkey * 7) % (m + m div 4))) as tag_id,
            c_mktsegment as source_type, concat('n', c_nationkey) as source_item,
            if(c_custkey % 17 = 0, null, array(named_struct('type_L1', c_mktsegment, 'type_L2', 'new'))) as tag_type,
            c_name as tag_name,
            concat('select c from VP_BANK.v_', c_custkey % n, ' a, vp_bank.v_', (c_custkey * 3) % n,
                   ' b where d >= ''$start_date''') as sql,
            case c_custkey % 3 when 0 then 'M' when 1 then 'd' else 'D' end as update_frequency,
            if(c_custkey % 4 = 0, null, cast(-(1 + c_custkey % 3) as int)) as started,
            if(c_custkey % 4 = 0, null, 1) as traced,
            c_name as description, '2024-01-01' as create_time, '2024-01-02' as update_time,
            cast(null as boolean) as disable_flag, 'sum' as score_method,
            if(c_custkey % 23 = 0, null, c_mktsegment) as attribute, 'feed' as creator,
            c_custkey % 2 = 0 as is_focus,
            case c_custkey % 4 when 0 then 'ats' when 1 then null when 2 then 'CRM' else 'ATS' end as system_name,
            array(concat('C', c_custkey)) as tickets
        from {c}""", c=feed)


def history(spark: SparkSession, sf: str) -> DataFrame:
    """History dictionary: the change feed's payloads as stored rows."""
    return changes(spark, sf).withColumn("tag_id", F.col("target_id")).drop("target_id")


def dictionary_text(spark: SparkSession, sf: str) -> DataFrame:
    """F2 as JSON, some rows broken: members left out, half a window, an absent flag."""
    return stored_dictionary(spark, sf).selectExpr("row_seq", """
        case when row_seq % 31 = 0 then to_json(s) else to_json(s, map('ignoreNullFields', 'false')) end as value
        """.replace("to_json(s", """to_json(named_struct(
            'tag_id', tag_id, 'source_type', source_type, 'source_item', source_item,
            'tag_type', coalesce(tag_type, array()), 'tag_name', tag_name, 'sql', sql,
            'update_frequency', update_frequency, 'started', started,
            'traced', if(row_seq % 37 = 0, null, traced), 'description', description,
            'create_time', create_time, 'update_time', update_time, 'disable_flag', disable_flag,
            'score_method', score_method, 'attribute', attribute, 'creator', creator,
            'is_focus', if(row_seq % 41 = 0, null, is_focus), 'system_name', system_name,
            'tickets', coalesce(tickets, array()))"""))


def nation_facts(spark: SparkSession, sf: str) -> DataFrame:
    """F5 with the entity's nation, laid over the months before and in F3, for tags that run their own SQL."""
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_nationkey").alias("nation"))
    day = F.date_add(F.lit("2023-06-01").cast("date"), (F.col("o_orderkey") % 245).cast("int"))
    recent = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("entity_id"), day.alias("day"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    return recent.join(customers, "entity_id")


def nation_tags(spark: SparkSession, sf: str) -> DataFrame:
    """one tag per nation with runnable SQL over ``tag_facts`` that names a view it waits for; some name a column
    that is not there."""
    nation = table(spark, sf, "nation").withColumn("n", _count(spark, sf, "supplier"))
    return spark.sql("""
        select cast(n_nationkey as bigint) as row_seq, concat('NATION_', n_nationkey) as tag_id,
            n_name as source_type, 'nation' as source_item, array(named_struct('type_L1', 'nation', 'type_L2', n_name)) as tag_type,
            n_name as tag_name,
            concat('/* VP_BANK.v_', n_nationkey % n, ' */ select entity_id, ',
                if(n_nationkey % 7 = 3, 'sum(no_such_column)', if(n_nationkey % 2 = 0, 'sum(amount)', 'count(1)')),
                ' as score from tag_facts where nation = ', n_nationkey,
                ' and day between date ''$start_date'' and date ''$end_date'' group by entity_id') as sql,
            if(n_nationkey % 3 = 0, 'M', 'D') as update_frequency,
            -(1 + n_nationkey % 6) as started, 1 + n_nationkey % 3 as traced,
            n_name as description, '2018-01-01' as create_time, '2018-09-22' as update_time, false as disable_flag,
            'sum' as score_method, 'nation' as attribute, 'fixture' as creator, false as is_focus,
            'ATS' as system_name, array('N') as tickets
        from {t}""", t=nation)
