"""Evidence-shaped inputs derived from the star-schema tables.

The tables hold customers, orders and parts; here they become packets, chunks of
'label: value' lines, table grids and run records.  All of it is plain DataFrame work, so
the inputs grow with the tables.  ``plans/ctes.py`` states the same inputs in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofgrain.session import rule_table, table

# field id, label, position
FIELDS = (
    ("customer.name", "Customer Name", 0),
    ("customer.segment", "Market Segment", 1),
    ("customer.balance", "Account Balance", 2),
    ("customer.nation", "Nation", 3),
    ("order.status", "Order Status", 4),
    ("order.priority", "Order Priority", 5),
    ("order.date", "Order Date", 6),
    ("order.remark", "Order Remark", 7),
)
ROLLOVER_DAY = "1998-04-13"


def money(col: Column) -> Column:
    return col.cast("decimal(15,2)").cast("string")


def day(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd")


def field_spec(spark: SparkSession, sf: str) -> DataFrame:
    """Form x field: coordinates, policies and labels."""
    fields = F.array(*[
        F.struct(F.lit(i).alias("field_id"), F.lit(n).alias("label"), F.lit(o).alias("ord"))
        for i, n, o in FIELDS
    ])
    spec = table(spark, sf, "region").select("r_name", "r_regionkey", F.inline(fields))
    o = F.col("ord")
    return spec.select(
        F.col("r_name").alias("form_id"),
        "field_id",
        "label",
        F.lit(0).alias("tbl"),
        F.floor(o / 2).cast("int").alias("row"),
        (o % 2).cast("int").alias("col"),
        o,
        (o % 4 != 3).alias("required"),
        (o % 3 == 0).alias("na_allowed"),
        (o == 7).alias("never_write"),
        ((o + F.col("r_regionkey")) % 5 != 0).alias("authorised"),
    )


def na_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Approved exceptions: fields that may be N/A, with a policy id."""
    return (
        field_spec(spark, sf)
        .where("na_allowed and ord <> 3")
        .select("form_id", "field_id", F.concat(F.lit("NA-"), F.col("ord").cast("string")).alias("policy_id"))
    )


def packets(spark: SparkSession, sf: str) -> DataFrame:
    """One packet per customer; the form is the customer's region."""
    return (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("packet_id"), F.col("r_name").alias("form_id"),
            "r_regionkey", "c_name", "c_mktsegment", "c_acctbal", "n_name",
        )
    )


def evidence_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """One chunk for the customer row and one per order, as 'Label: value' lines."""
    p = packets(spark, sf)
    customer = p.select(
        "packet_id", "form_id",
        F.lit("customers.csv").alias("source_file"), F.lit("csv").alias("source_type"),
        F.concat(F.lit("c."), F.col("packet_id").cast("string")).alias("chunk_id"),
        F.lit(None).cast("int").alias("page"),
        F.concat(
            F.lit("Customer Name: "), "c_name", F.lit("\nMarket Segment: "), "c_mktsegment",
            F.lit("\nAccount Balance: "), money(F.col("c_acctbal")), F.lit("\nNation: "), "n_name",
        ).alias("text"),
        F.col("form_id").alias("scope_hint"),
    )
    # every order is kept; some customers' orders say nothing, and some say the same thing
    tenth = F.col("o_custkey") % 10
    nothing, same = tenth == 0, tenth.isin(1, 2, 3)
    regions = table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("other_form"))
    k = F.col("o_orderkey")
    is_json = k % 5 == 0
    order = (
        # orders grow; their file is small beside their rows, and sent to every task they would pass
        # the driver and leave the work to the few tasks that read the customers
        table(spark, sf, "orders").hint("merge").join(p, F.col("o_custkey") == F.col("packet_id"))
        .join(regions, (F.col("r_regionkey") + 1) % 5 == F.col("k"))
        .select(
            "packet_id", "form_id",
            F.concat(F.lit("orders_"), (k % 4).cast("string"), F.lit(".csv")).alias("source_file"),
            F.when(is_json, "json").otherwise("csv").alias("source_type"),
            F.concat(F.lit("o."), k.cast("string")).alias("chunk_id"),
            F.when(k % 2 == 0, (k % 9).cast("int")).alias("page"),
            F.when(nothing, F.concat(F.lit("Order "), k.cast("string"), F.lit(" came without details"))).otherwise(F.concat(
                F.when(is_json, "order.status: ").when(k % 6 == 1, "Status: ").otherwise("Order Status: "),
                F.when(same, "F").otherwise(F.col("o_orderstatus")), F.lit("\n"),
                F.when(k % 7 == 3, "Shipping / Order Priority (code): ").otherwise("Order Priority: "),
                F.when(same, "5-LOW").otherwise(F.col("o_orderpriority")), F.lit("\n"),
                F.when(k % 8 == 2, "Date = ").otherwise("Order Date: "),
                F.when(same, F.concat(F.lit("1995-0"), (F.col("o_custkey") % 9 + 1).cast("string"), F.lit("-15"))).when(k % 13 == 0, "pending").otherwise(day(F.col("o_orderdate"))),
            )).alias("text"),
            F.when(k % 7 == 0, None).when(k % 11 == 0, F.col("other_form")).otherwise(F.col("form_id")).alias("scope_hint"),
        )
    )
    return customer.unionByName(order)


def label_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Noisy 'label: value' text per order: carried values, markers, bare pipes, repeats."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("doc_id"),
        F.concat(
            F.lit("Order Status: "), "o_orderstatus",
            F.when(k % 3 == 0, "\nOrder Priority:\n").otherwise("\nOrder Priority: "), "o_orderpriority",
            F.when(k % 4 == 0, "\nOrder Status: X").otherwise("\nfree text without a pair"),
            F.when(k % 6 == 0, "\nOrder Priority:\n\nurgent handling").otherwise(""),
            F.when(k % 5 == 0, "\ntable_0_row_1: Order (Date) of the Car | ").otherwise("\nDate: "),
            day(F.col("o_orderdate")),
            F.when(k % 7 == 0, "\nOrder Status: REVIEW_REQUIRED: order.status missing").otherwise(""),
            F.when(k % 11 == 0, F.concat(F.lit("\nNotes: "), F.repeat(F.lit("long text "), 20))).otherwise(""),
            F.when(k % 9 == 0, F.concat(F.lit("\nCalibration Due: "), F.date_format("o_orderdate", "M/d/yyyy"))).otherwise(""),
        ).alias("text"),
    )


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """Table cells: a label row over a value row per part, and a register table per order."""
    part = table(spark, sf, "part")
    wide = F.when(F.col("p_partkey") % 3 == 0, 1).otherwise(0)
    merged = F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(0)

    def cell(row: int, col: Column, span: Column, text: Column) -> Column:
        return F.struct(
            F.lit(row).alias("row"), col.cast("int").alias("col"),
            span.cast("int").alias("span"), text.alias("text"),
        )

    one = F.lit(1)
    parts = part.select(
        F.col("p_partkey").alias("doc"), F.lit(0).alias("tbl"),
        F.inline(F.array(
            cell(0, F.lit(0), 1 + wide, F.lit("Part Name")),
            cell(0, 1 + wide, one, F.lit("Brand Code")),
            cell(0, 2 + wide, one, F.lit("Material Type")),
            cell(0, 3 + wide, one, F.lit("Part Size")),
            cell(1, F.lit(0), 1 + wide + merged, F.col("p_name")),
            cell(1, 1 + wide + merged, one, F.col("p_brand")),
            cell(1, 2 + wide + merged, one, F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_type"))),
            cell(1, 3 + wide + merged, one, F.col("p_size").cast("string")),
        )),
    )
    lines = numbered_lines(spark, sf)
    k = F.col("l_orderkey")
    shown = F.date_format("l_shipdate", "M/d/yyyy")
    due = F.date_format(F.date_add(F.col("l_shipdate").cast("date"), 365), "M/d/yyyy")
    tag = F.concat(F.lit("U"), F.lpad(F.col("l_partkey").cast("string"), 7, "0"))
    twin = k % 23 == 0
    body = lines.select(
        (k + 1000000).alias("doc"), F.lit(1).alias("tbl"), F.col("rn").cast("int").alias("row"),
        F.posexplode(F.array(
            F.when(k % 13 == 0, F.concat(tag, F.lit(" | "), F.col("l_suppkey").cast("string")))
            .when(k % 19 == 0, F.concat(tag, F.lit(" "), shown, F.lit(" "), due)).otherwise(tag),
            F.when(twin, F.lit("same text")).when(k % 17 == 0, tag).otherwise(shown),
            F.when(twin, F.lit("same text")).when(F.col("l_linenumber") == 6, "1/1/1990").otherwise(due),
            F.when(twin, F.lit("Same Text"))
            .when(k % 29 == 0, F.repeat(F.lit("overflow "), 25)).otherwise(F.col("l_returnflag")),
        )).alias("col", "text"),
    ).select("doc", "tbl", "row", "col", F.lit(1).alias("span"), "text")
    head = table(spark, sf, "lineitem").select("l_orderkey").distinct().select(
        (k + 1000000).alias("doc"), F.lit(1).alias("tbl"), F.lit(0).alias("row"),
        F.posexplode(F.array(*[F.lit(h) for h in ("Equipment ID", "Calibration Date", "Due Date", "Status")])).alias("col", "text"),
    ).select("doc", "tbl", "row", "col", F.lit(1).alias("span"), "text")
    return parts.unionByName(head).unionByName(body)


def grid_after(spark: SparkSession, sf: str) -> DataFrame:
    """The grid after a run that lost a row in some documents."""
    return lost_rows(grid(spark, sf))


def lost_rows(cells: DataFrame) -> DataFrame:
    return cells.where("not (doc % 17 = 0 and row = 1)")


def numbered_lines(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    return table(spark, sf, "lineitem").withColumn("rn", F.row_number().over(order))


def index_prev(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("doc_id % 10 <> 0").select(
        F.col("doc_id").cast("string").alias("name"), F.sha2("text", 256).alias("hash")
    )


def index_cur(spark: SparkSession, sf: str) -> DataFrame:
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return table(spark, sf, "documents").where("doc_id % 10 <> 1").select(
        F.col("doc_id").cast("string").alias("name"), F.sha2(changed, 256).alias("hash")
    )


def period_values(spark: SparkSession, sf: str, new: bool) -> DataFrame:
    """Per customer, the latest value of each order field before or after the rollover day."""
    when = F.col("o_orderdate") >= F.lit(ROLLOVER_DAY).cast("timestamp_ntz")
    rows = table(spark, sf, "orders").where(when if new else ~when)
    latest = rows.groupBy("o_custkey").agg(
        F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus", "o_orderpriority")).alias("m")
    )
    return latest.select(
        F.col("o_custkey").alias("packet_id"),
        F.inline(F.array(
            F.struct(F.lit("order.status").alias("field_id"), F.lit("Order Status").alias("label"), F.col("m.o_orderstatus").alias("value")),
            F.struct(F.lit("order.priority").alias("field_id"), F.lit("Priority Auditor").alias("label"), F.col("m.o_orderpriority").alias("value")),
            F.struct(F.lit("order.date").alias("field_id"), F.lit("Order Date").alias("label"), day(F.col("m.o_orderdate")).alias("value")),
        )),
    )


def run_records(spark: SparkSession, sf: str) -> DataFrame:
    """One record per order line with provenance, mode, claim and structure flags."""
    k, n = F.col("l_orderkey"), F.col("rn")
    s = k + n

    def pick(value: Column, *options: str) -> Column:
        return F.element_at(F.array(*[F.lit(o) for o in options]), (value % len(options) + 1).cast("int"))

    return numbered_lines(spark, sf).select(
        k.alias("run_id"),
        F.concat(k.cast("string"), F.lit("-"), n.cast("string")).alias("item"),
        pick(s, "exact", "alias", "Substring").alias("method"),
        pick(s, "current_run", "current_run", "current_run", "prior_run").alias("coordinate_source"),
        F.when(s % 5 == 0, F.array(F.lit("Page"), F.lit("label")))
        .when(s % 5 == 1, F.array(F.lit("form_version"), F.lit("label")))
        .otherwise(F.array(F.lit("form_version"), F.lit("section"), F.lit("label"))).alias("keyed_by"),
        pick(s, "approved", "approved", "run_derived").alias("map_source"),
        (s % 2 == 0).alias("validated"),
        F.lit("order.status").alias("source_field"),
        F.when(s % 9 == 0, "order.date").otherwise("order.status").alias("target_field"),
        pick(k, "New Work", "rework", "roll-over", "Rollover", "final review", "", "CORRECTION").alias("mode"),
        pick(k, "blank", "working form", "blank").alias("started_from"),
        F.when(k % 11 == 0, "corrupted").when(k % 11 == 1, "because").alias("rebuild_reason"),
        (k % 4 == 0).alias("accepted_baseline"),
        (n % 2 == 1).alias("was_correct"),
        F.when(s % 6 == 0, "").otherwise(F.col("l_returnflag")).alias("target_value"),
        F.when(s % 3 == 0, F.array(F.lit("text"))).otherwise(F.array(F.lit("text"), F.lit("table"))).alias("surfaces"),
        (s % 8 != 0).alias("environment_ok"),
        (s % 2 == 1).alias("asserted"),
        pick(s, "record", "Master_List", "report").alias("support"),
        pick(k, "DRAFT", "final", "draft").alias("status"),
        pick(n, "SIGNATURE_BLANK", "TYPO").alias("finding_type"),
        F.when(k % 5 != 0, F.col("l_linenumber").cast("string")).alias("requested"),
        (F.col("l_linenumber") + F.when(s % 10 == 0, 100).otherwise(0)).cast("string").alias("delivered"),
        pick(s, "filesystem_walk", "file_list", "file_list", "file_list").alias("snapshot_source"),
    )
