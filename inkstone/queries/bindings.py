"""The engine's concepts bound to the driver's tables.

Each binding is a select list that Spark and DuckDB read alike, so that both sides of a comparison
start from the same rows; the operators under test are written separately for each.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# name: (source tables, select)
TABLES: dict[str, tuple[str, str]] = {
    # the corpus: one sentence for each document, with a catalogue id and a reign date
    "corpus": (
        "documents",
        """select doc_id as seq, concat('DIA-A', lpad(cast(doc_id % 27 + 1 as string), 2, '0'), '010010-', lpad(cast(doc_id as string), 5, '0')) as id,
        concat('A', lpad(cast(doc_id % 27 + 1 as string), 2, '0'), '0101') as date, text as original, source, lang from documents""",
    ),
    # parallel text: a user's turn and the assistant's answer
    "pairs": (
        "conversations",
        """select u.conv_id * 1000 + u.turn as seq, cast(u.conv_id as string) as id, u.text as original, a.text as translation
        from conversations u join conversations a on u.conv_id = a.conv_id and u.turn + 1 = a.turn where u.role = 'user' and a.role = 'assistant'""",
    ),
    "job": (
        "orders",
        """select cast(o_orderkey as string) as id, o_orderkey as seq, concat('key-', cast(o_orderkey % 5000 as string)) as idempotency_key,
        cast(1623 + o_orderkey % 27 as int) as doc_year, case when o_orderstatus = 'F' then 'SUCCEEDED' when o_orderkey % 11 = 0 then 'DEAD'
        when o_orderkey % 7 = 0 then 'FAILED' when o_orderstatus = 'O' then 'PENDING' else 'RUNNING' end as status,
        case when o_orderkey % 5 = 0 then null when o_orderkey % 3 = 0 then 'fake-model' else concat('model-', substring(o_orderpriority, 1, 1)) end as model_used,
        case when o_orderkey % 4 = 0 then 'REJECTED' when o_orderkey % 4 = 1 then 'DEGRADED' else 'VERIFIED' end as quality_grade,
        cast(floor(o_totalprice) as bigint) % 2000 as tokens_in, cast(floor(o_totalprice) as bigint) % 700 as tokens_out,
        concat('v', cast(o_custkey % 3 as string)) as prompt_version, cast(o_custkey % 40 as string) as batch_id, cast(o_custkey % 7 as string) as tenant_id,
        o_orderdate as completed_at, cast(o_custkey as string) as normalized_hash from orders""",
    ),
    # one row for each model call
    "ledger": (
        "lineitem",
        """select cast(l_orderkey as string) as job_id, concat('model-', l_returnflag) as model, cast(floor(l_quantity) as bigint) * 10 as tokens_in,
        cast(floor(l_quantity) as bigint) * 3 as tokens_out, l_linenumber as call_no, l_shipdate as recorded_at,
        cast(case when l_returnflag = 'A' then 0.300000 when l_returnflag = 'N' then 1.250000 else 2.500000 end as decimal(12, 6)) as unit_price_in from lineitem""",
    ),
    "rate_event": (
        "events",
        """select event_id, user_id, concat('model-', cast(user_id % 4 as string)) as model, cast(user_id % 9 as string) as tenant_id, ts, event_type, value, props from events""",
    ),
    # two arms that translate the same sentences
    "arm": (
        "documents",
        """select 'a' as arm, doc_id as id, text as hypothesis, lang as pattern, source as stratum from documents where doc_id % 5 <> 0
        union all select 'b' as arm, doc_id as id, lower(text) as hypothesis, lang as pattern, source as stratum from documents where doc_id % 7 <> 0""",
    ),
    # graded scores of an arm's rounds
    "score": (
        "lineitem",
        """select concat('p', cast(l_suppkey % 6 as string)) as variant, l_linenumber as round, cast(l_orderkey as string) as id, l_quantity as hit, l_quantity + l_linenumber as total,
        l_extendedprice as value from lineitem""",
    ),
}


def names_of(uses: str) -> list[str]:
    """Binding names in a comma-separated list."""
    return [n.strip() for n in uses.split(",") if n.strip()]


def with_tables(uses: str, sql: str) -> str:
    """A statement with the bindings that it uses as common tables."""
    names = names_of(uses)
    if not names:
        return sql
    ctes = ",\n".join(f"{n} as ({TABLES[n][1]})" for n in names)
    body = sql.strip()
    return f"with {ctes},\n{body[5:]}" if body.lower().startswith("with ") else f"with {ctes}\n{body}"


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A binding, or a driver table of that name, as a DataFrame."""
    if name not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    source, select = TABLES[name]
    # spark.sql takes the source as a DataFrame parameter, so no view is registered
    statement = re.sub(rf"\b(from|join) {source}\b", rf"\1 {{{source}}}", select)
    return spark.sql(statement, **{source: spark.read.parquet(f"{sf_dir}/{source}.parquet")})
