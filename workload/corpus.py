"""Source texts derived from the given tables.

The SQL below is run by Spark and by the checking engine alike, so it keeps to what
both read the same way: ``chr`` for special characters, ``||`` and ``CASE``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts are built and scanned in tasks of at most about so many; streams come in so many parts.
ROWS_PER_TASK = 20_000
PARTS = 3

NL, TAB, QUOTE, TICK, BACKSLASH = "chr(10)", "chr(9)", "chr(34)", "chr(39)", "chr(92)"


def _on(condition: str, *parts: str) -> str:
    return f"CASE WHEN {condition} THEN {' || '.join(parts)} ELSE '' END"


def _line(text: str) -> str:
    quoted = text.replace("'", "''")
    return f"'    {quoted}' || {NL}"


def contract_sql(key: str, note: str) -> str:
    """One contract text per row: which hazards it holds follows from ``key``."""
    k, name = key, f"cast({key} AS STRING)"
    word = f"md5({name})"
    body = [
        _on(f"{k} % 6 = 0", _line('(bool ok, ) = msg.sender.call{value: amount}("");')),
        _on(f"{k} % 5 = 0", _line("require(tx.origin == boss);")),
        _on(f"{k} % 5 = 1", _line("// require(tx.origin == boss);")),
        _on(f"{k} % 7 = 3", _line("selfdestruct(payable(msg.sender));")),
        _on(f"{k} % 4 = 1", _line("uint t = block.timestamp;")),
        _on(f"{k} % 8 = 1", _line("require(block . timestamp > a && block.timestamp < b);")),
        _on(f"{k} % 9 = 4", _line("impl.delegatecall(data); /* impl.delegatecall(data); */")),
        _on(f"{k} % 10 = 7", _line("target.call(data);")),
        _on(f"{k} % 11 = 5", _line("uint r = uint(keccak256(abi.encodePacked(block.number, a)));")),
        _on(f"{k} % 22 = 5", "'    bytes32 z = keccak256 ( abi.encodePacked(a,' || chr(10) || '        block.difficulty));' || chr(10)"),
        _on(f"{k} % 13 = 2", _line("bytes32 h = sha3(x);")),
        _on(f"{k} % 13 = 7", _line("suicide(heir); other.callcode (data);")),
        _on(f"{k} % 8 = 2", _line("address keeper = _keeper;")),
        _on(f"{k} % 12 = 5", _line("assembly { let x := 1 }")),
        _on(f"{k} % 12 = 6", f"'    assembly (' || {QUOTE} || 'memory-safe' || {QUOTE} || ') {{ }}' || {NL}"),
        _on(f"{k} % 14 = 9", f"'    address token = 0x' || {word} || substring({word}, 1, 8) || ';' || {NL}"),
        _on(f"{k} % 14 = 10", f"'    bytes21 mark = 0x' || {word} || substring({word}, 1, 9) || ';' || {NL}"),
        _on(f"{k} % 9 = 1", _line("(uint r0, uint r1, ) = pair.getReserves();")),
        _on(f"{k} % 10 = 3", _line("unchecked { n += 1; }")),
        _on(f"{k} % 6 = 1", _line("owner = msg.sender; if (owner == next) { governance  =  next; }")),
        _on(f"{k} % 12 = 7", _line("address s = ecrecover(h, v, r, s2);")),
        _on(f"{k} % 7 = 5", _line("for (uint i = 0; i < users.length; i++) { for (uint j; j < n; j++) {} }")),
        _on(f"{k} % 21 = 5", f"'    for (uint i;' || {NL} || '        i < users.length; for (a.length' || {NL} || '    ) {{}}' || {NL}"),
        _on(f"{k} % 9 = 2",
            f"'    string s = ' || {QUOTE} || 'http://a' || {BACKSLASH} || {QUOTE} || '// b tx.origin' || {QUOTE} || '; tx.origin;' || {NL}"),
        _on(f"{k} % 19 = 4", f"'    /* it' || {TICK} || 's */ it' || {TICK} || 's // tx.origin' || {NL} || '    ' || {TICK} || ' // tx.origin' || {NL}"),
        _on(f"{k} % 17 = 2", f"'    tx.origin; // a' || {TAB} || chr(160) || chr(13) || {NL} || {TAB} || chr(13) || {NL}"),
        _on(f"{k} % 21 = 3", f"'    tx.origin ' || repeat('é', 100) || '  ' || {NL}"),
        _on(f"{k} % 21 = 4", f"'    tx.origin  ' || repeat('é', 100) || {NL}"),
        _on(f"{k} % 21 = 6", f"'    tx.origin ' || repeat('a', 200) || '  ' || {NL}"),
        _on(f"{k} % 29 = 6", f"chr(1) || 'tx.origin tx.origin' || chr(1) || {NL}"),
        _on(f"{k} % 16 = 11", f"'    tx./*' || {NL} || ' gap */origin; éowner = x; owner' || chr(11) || '= x;' || {NL}"),
        _on(f"{k} % 499 = 0", f"repeat('    admin = next;' || {NL}, 130)"),
        _on(f"{k} % 5 = 2", _line("function mint(address to, uint n) external onlyOwner { _mint(to, n); }")),
    ]
    parts = [
        f"CASE {k} % 4 WHEN 0 THEN '// SPDX-License-Identifier: MIT' || {NL} "
        f"WHEN 1 THEN '/* order ' || {name} || {NL} || ' * tx.origin is not safe' || {NL} || ' */' || {NL} ELSE '' END",
        f"CASE {k} % 7 WHEN 0 THEN 'pragma solidity ^0.8.0;' || {NL} WHEN 1 THEN 'pragma solidity 0.8.24;' || {NL} "
        f"WHEN 2 THEN 'pragma solidity 0.6.12;' || {NL} WHEN 3 THEN 'pragma solidity >=0.4.22 <0.9.0;' || {NL} "
        f"WHEN 4 THEN '// pragma solidity ^0.7.0;' || {NL} "
        f"WHEN 5 THEN 'pragma' || {NL} || 'solidity' || {NL} || ' 0.8.1 ;' || {NL} ELSE 'pragma solidity  ;' || {NL} END",
        f"'contract C' || {name} || ' {{' || {NL} || '    // ' || {note} || {NL} || {NL}",
        f"'    function f(uint a) public returns (bool) {{ return a > ' || {name} || '; }}' || {NL}",
        # One text in ten is clean but for its pragma.
        f"CASE WHEN {k} % 10 = 9 THEN '' ELSE {' || '.join(body)} END",
        f"'}}' || {NL}",
        _on(f"{k} % 23 = 0", "'/* tx.origin'"),
    ]
    return " || ".join(parts)


ORDER_TEXT = contract_sql("o_orderkey", "o_orderpriority")


def path_sql(key: str) -> str:
    return f"'/src/d' || cast({key} % 97 AS STRING) || '/Order' || cast({key} AS STRING) || '.sol'"


ORDER_PATH = path_sql("o_orderkey")
# Orders of one customer claim the same path, and a third of all orders claim one
# path; the smallest key comes first.
SHARED_PATH = (
    "'/src/Customer' || cast(CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey END AS STRING) || '.sol'"
)
DOCUMENT_PATH = "'/doc/' || cast(doc_id AS STRING)"
NOTED_TEXT = (
    f"'/* ' || text || ' */ tx.origin;' || {NL} || '// ' || text || {NL} || 'string s = ' || {QUOTE} || text "
    f"|| {QUOTE} || '; // tx.origin' || {NL} || 'admin = ' || {TICK} || text || {TICK} || ';' || {NL}"
)
PAGE_PATH = "'/page/' || cast(page_id AS STRING)"

# Detector results: one document per event, for the order file the event points to.
# A third of the events point to the first file, and some to files that are not there.
EVENT_PATH = path_sql("(CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id * 2 END)")


def detector_sql() -> str:
    """JSON text of one event's detector run, malformed and failed runs included."""
    check = "event_type"
    impact = ("CASE event_id % 5 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Low' "
              "WHEN 3 THEN 'Informational' ELSE 'Optimization' END")
    lines = ("CASE event_id % 4 WHEN 0 THEN '[]' WHEN 1 THEN '[{''source_mapping'': {''lines'': []}}]' "
             "ELSE '[{''source_mapping'': {''lines'': [' || cast(event_id % 90 + 1 AS STRING) || ', 7]}}, "
             "{''source_mapping'': {''lines'': [3]}}]' END")
    first = (f"'{{''check'': ''' || {check} || ''', ''impact'': ''' || {impact} || ''', ''description'': ''found ' "
             f"|| cast(event_id AS STRING) || ''', ''elements'': ' || {lines} || '}}'")
    second = "CASE WHEN event_id % 6 = 1 THEN ', {''check'': ''extra'', ''impact'': ''High'', ''elements'': []}' ELSE '' END"
    good = ("'{''success'': ' || CASE WHEN event_id % 11 = 5 THEN 'false' ELSE 'true' END || "
            f"', ''results'': {{''detectors'': [' || {first} || {second} || ']}}}}'")
    text = (f"CASE WHEN event_id % 13 = 4 THEN '{{''success'': tru' "
            f"WHEN event_id % 17 = 6 THEN '{{''success'': true, ''results'': {{}}}}' "
            f"WHEN event_id % 23 = 7 THEN {good} || ' oops' WHEN event_id % 23 = 8 THEN {good} || {good} "
            f"WHEN event_id % 23 = 9 THEN ' ' || {good} || {NL} ELSE {good} END")
    return f"replace({text}, {TICK}, {QUOTE})"


DETECTOR_TEXT = detector_sql()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Give a small table of texts, which arrives in one split, to all cores.

    A table with enough splits is left as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() >= cores:
        return rows
    return rows.repartition(cores * 2, *keys)


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for so many key rows: two for each core, and more of them, not longer ones, as the table grows."""
    return max(spark.sparkContext.defaultParallelism * 2, -(-rows // ROWS_PER_TASK))


def spread_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Deal the narrow rows that texts are built from by their number.

    A split holds some megabytes of keys, and the work on the texts of one is many times that of reading it, so
    splits say nothing about the tasks that are needed. Rows of a Parquet table are counted from its footers.
    """
    return rows.repartition(tasks_for(rows.sparkSession, rows.count()), *keys)


def _streamed(orders: DataFrame, rows: int, *texts: str) -> DataFrame:
    """Contracts from a streaming orders table of about ``rows`` rows in a micro-batch."""
    keys = orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    return keys.repartition(tasks_for(orders.sparkSession, rows), "o_orderkey").selectExpr(*texts)


def streamed_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders table as a stream of ``path, content``."""
    orders = table(spark, sf_dir, "orders")
    # As a pattern the path serves a file and a folder of part files.
    stream = spark.readStream.schema(orders.schema).parquet(f"{sf_dir}/orders.parque[t]")
    return _streamed(stream, orders.count(), f"{ORDER_PATH} AS path", f"{ORDER_TEXT} AS content")


def _arriving(keys: DataFrame, key: str, folder: str, parts: int) -> DataFrame:
    """``keys`` as a stream of about ``parts`` micro-batches, however many files there are."""
    spark, files = keys.sparkSession, 1
    for part in range(parts):
        keys.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part).write.parquet(f"{folder}/{part}")
        files = max(files, len(spark.read.schema(keys.schema).parquet(f"{folder}/{part}").inputFiles()))
    # A micro-batch takes as many files as a part has at most; a batch has its price whatever it holds.
    return spark.readStream.schema(keys.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/*")


def arriving_orders(spark: SparkSession, sf_dir: str, folder: str, parts: int = PARTS) -> DataFrame:
    """The orders as a stream of several micro-batches, late keys first in some of them."""
    keys = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return _arriving(keys, "o_orderkey", folder, parts)


def arriving_results(spark: SparkSession, sf_dir: str, folder: str, parts: int = PARTS) -> DataFrame:
    """``path, json`` of the detector run of every event, in several micro-batches."""
    keys = table(spark, sf_dir, "events").select("event_id", "event_type")
    stream = _arriving(keys, "event_id", folder, parts)
    return stream.repartition(tasks_for(spark, keys.count() // parts), "event_id").selectExpr(
        f"{EVENT_PATH} AS path", f"{DETECTOR_TEXT} AS json")


def _arriving_texts(spark: SparkSession, sf_dir: str, folder: str, *texts: str) -> DataFrame:
    orders = arriving_orders(spark, sf_dir, folder)
    return _streamed(orders, table(spark, sf_dir, "orders").count() // PARTS, *texts)


def arriving_contracts(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """``path, content`` of every order, in several micro-batches."""
    return _arriving_texts(spark, sf_dir, folder, f"{ORDER_PATH} AS path", f"{ORDER_TEXT} AS content")


def arriving_shared_contracts(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """``path, content, seq``, one path per customer, in several micro-batches."""
    return _arriving_texts(spark, sf_dir, folder, f"{SHARED_PATH} AS path", f"{ORDER_TEXT} AS content", "o_orderkey AS seq")


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("o_orderkey", "o_custkey", "o_orderpriority")
    return spread_keys(table(spark, sf_dir, "orders").select(*columns), "o_orderkey")


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, content`` for every order."""
    return order_rows(spark, sf_dir).selectExpr(f"{ORDER_PATH} AS path", f"{ORDER_TEXT} AS content")


def contract_rules(spark: SparkSession, sf_dir: str, first: int) -> DataFrame:
    """One rule for each order, which names its contract; orders of rules begin at ``first``."""
    keys = spread_keys(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    place = F.col("o_orderkey").cast("int") + first
    texts = {n: F.lit("") for n in ("title", "description", "swc", "cwe", "recommendation")}
    return keys.select(
        place.alias("rule_order"), F.concat(F.lit("ORD-"), "o_orderkey").alias("rule_id"), F.lit("INFO").alias("severity"),
        *[value.alias(name) for name, value in texts.items()], F.array().cast("array<string>").alias("references"),
        F.concat(F.lit(r"contract\s+C"), "o_orderkey", F.lit(r"\s*\{")).alias("regex"))


def shared_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, content, seq``: one row per order, one path per customer."""
    return order_rows(spark, sf_dir).selectExpr(
        f"{SHARED_PATH} AS path", f"{ORDER_TEXT} AS content", "o_orderkey AS seq"
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spread(rows, "doc_id").selectExpr(f"{DOCUMENT_PATH} AS path", "text AS content")


def noted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts inside comments and strings of a contract."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spread(rows, "doc_id").selectExpr(f"{DOCUMENT_PATH} AS path", f"{NOTED_TEXT} AS content")


def chunked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts as ``path, seq, content`` in chunks whose length follows from the document."""
    rows = noted_documents(spark, sf_dir).withColumn("size", F.expr("300 + crc32(encode(path, 'UTF-8')) % 700"))
    # Cut in one pass: a substring is looked for from the start of its text.
    pieces = F.regexp_extract_all("content", F.concat(F.lit("(?s).{1,"), F.col("size").cast("string"), F.lit("}")), F.lit(0))
    return rows.where("content <> ''").select("path", F.posexplode(pieces).alias("seq", "content")).select(
        "path", F.col("seq").cast("long").alias("seq"), "content")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "html")
    return spread(rows, "page_id").selectExpr(f"{PAGE_PATH} AS path", "html AS content")


def detector_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, json``: one detector run for every event."""
    columns = ("event_id", "event_type")
    events = spread_keys(table(spark, sf_dir, "events").select(*columns), "event_id")
    return events.selectExpr(f"{EVENT_PATH} AS path", f"{DETECTOR_TEXT} AS json")
