"""Sources and sinks with declared schemas."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ASSET = "STRUCT<asset_type:STRING,asset_code:STRING,asset_issuer:STRING>"
_FLAGS = "STRUCT<auth_required:BOOLEAN,auth_revocable:BOOLEAN,auth_immutable:BOOLEAN,auth_clawback_enabled:BOOLEAN>"
_KEYS = "ARRAY<STRUCT<key_type:STRING,contract:STRING,key:STRING,durability:STRING>>"
_GROUPS = "STRUCT<authorized:{0},authorized_to_maintain_liabilities:{0},unauthorized:{0}>"
_BALANCE = (
    "STRUCT<asset_type:STRING,asset_code:STRING,asset_issuer:STRING,balance:STRING,limit:STRING,buying_liabilities:STRING,"
    "selling_liabilities:STRING,is_authorized:BOOLEAN,is_authorized_to_maintain_liabilities:BOOLEAN,liquidity_pool_id:STRING>"
)


def _columns(*groups: tuple[str, str]) -> str:
    """DDL of (type, names) groups."""
    return ", ".join(f"`{name}` {kind}" for kind, names in groups for name in names.split())


# The declared schemas of raw tables; all columns nullable. Amounts and 64-bit numbers are text.
SCHEMAS = {
    "ledgers": _columns(
        ("STRING", "id hash prev_hash"), ("BIGINT", "sequence"), ("INT", "successful_transaction_count failed_transaction_count operation_count tx_set_operation_count"),
        ("STRING", "closed_at total_coins fee_pool"), ("BIGINT", "base_fee_in_stroops base_reserve_in_stroops"), ("INT", "max_tx_set_size protocol_version"),
    ),
    "transactions": _columns(
        ("STRING", "id hash"), ("BOOLEAN", "successful"), ("BIGINT", "ledger_attr ledger"), ("STRING", "created_at source_account source_account_sequence fee_account fee_charged max_fee"),
        ("INT", "operation_count"), ("STRING", "memo_type memo result_code"), ("STRUCT<transaction:STRING,operations:ARRAY<STRING>>", "result_codes"),
        ("STRUCT<hash:STRING,max_fee:STRING>", "inner_transaction"), ("BIGINT", "min_time max_time min_ledger max_ledger"),
    ),
    "operations": _columns(
        ("STRING", "id paging_token type source_account created_at transaction_hash"), ("BOOLEAN", "transaction_successful"), ("STRING", "from to funder account into trustor amount asset_type asset_code asset_issuer"),
    ),
    "payments": _columns(
        ("STRING", "id paging_token type source_account created_at transaction_hash"), ("BOOLEAN", "transaction_successful"), ("BIGINT", "ledger"),
        ("STRING", "from from_muxed to to_muxed amount asset_type asset_code asset_issuer source_amount source_asset_type source_asset_code source_asset_issuer"),
        ("STRING", "destination_amount destination_asset_type destination_asset_code destination_asset_issuer funder account starting_balance into into_muxed"),
    ),
    "effects": _columns(
        ("STRING", "id type account source_account created_account destination created_at contract"), ("STRUCT<id:STRING>", "liquidity_pool"),
        ("STRING", "asset_code asset_issuer asset_type amount starting_balance trustor offer_id seller sponsor new_sponsor former_sponsor balance_id"), ("INT", "weight"), ("STRING", "name"),
    ),
    "trades": _columns(
        ("STRING", "id paging_token ledger_close_time trade_type base_account base_liquidity_pool_id base_amount base_asset_type base_asset_code base_asset_issuer"),
        ("STRING", "counter_account counter_liquidity_pool_id counter_amount counter_asset_type counter_asset_code counter_asset_issuer"), ("BOOLEAN", "base_is_seller"), ("STRUCT<n:STRING,d:STRING>", "price"),
    ),
    "offers": _columns(
        ("STRING", "id paging_token seller"), (_ASSET, "selling buying"), ("STRING", "amount price"), ("STRUCT<n:STRING,d:STRING>", "price_r"), ("BIGINT", "last_modified_ledger"), ("STRING", "last_modified_time"),
    ),
    "assets": _columns(
        ("STRING", "asset_type asset_code asset_issuer paging_token"), ("BIGINT", "num_accounts"), (_GROUPS.format("BIGINT"), "accounts"), (_GROUPS.format("STRING"), "balances"),
        ("BIGINT", "num_claimable_balances"), ("STRING", "claimable_balances_amount"), ("BIGINT", "num_liquidity_pools"), ("STRING", "liquidity_pools_amount"), ("BIGINT", "num_contracts"),
        ("STRING", "contracts_amount"), (_FLAGS, "flags"),
    ),
    "liquidity_pools": _columns(
        ("STRING", "id paging_token"), ("INT", "fee_bp"), ("STRING", "type"), ("BIGINT", "total_trustlines"), ("STRING", "total_shares"), ("ARRAY<STRUCT<asset:STRING,amount:STRING>>", "reserves"),
        ("BIGINT", "last_modified_ledger"), ("STRING", "last_modified_time"),
    ),
    "claimable_balances": _columns(("STRING", "id asset amount"), ("ARRAY<STRUCT<destination:STRING,predicate:STRING>>", "claimants"), ("BIGINT", "last_modified_ledger")),
    "accounts": _columns(
        ("STRING", "id sequence"), ("INT", "subentry_count num_sponsored num_sponsoring"), ("STRING", "sponsor home_domain"), ("STRUCT<low_threshold:INT,med_threshold:INT,high_threshold:INT>", "thresholds"),
        (_FLAGS, "flags"), ("ARRAY<STRUCT<key:STRING,weight:INT>>", "signers"), (f"ARRAY<{_BALANCE}>", "balances"), ("MAP<STRING,STRING>", "data_attr"),
    ),
    "contract_events": _columns(
        ("STRING", "id type"), ("BIGINT", "ledger"), ("STRING", "ledger_closed_at tx_hash contract_id"), ("ARRAY<STRUCT<xdr_type:STRING,value:STRING>>", "topic"), ("STRUCT<xdr_type:STRING,value:STRING>", "value"),
        ("BOOLEAN", "in_successful_contract_call"), ("STRING", "paging_token"),
    ),
    "storage_entries": _columns(("STRING", "contract_id key durability value"), ("BIGINT", "last_modified_ledger live_until_ledger")),
    "simulations": _columns(
        ("STRING", "id contract_id status error min_resource_fee"), ("BIGINT", "instructions read_bytes write_bytes"), (_KEYS, "read_only read_write"),
        ("ARRAY<STRUCT<key:STRING,before:STRING,after:STRING>>", "state_changes"), ("ARRAY<STRUCT<ok:BOOLEAN,type:STRING,contract:STRING>>", "events"),
    ),
    "transfers": _columns(("STRING", "transaction_id"), ("TIMESTAMP", "polled_at"), ("STRING", "status amount_in amount_out amount_fee message")),
}


def read_table(spark: SparkSession, folder: str, name: str, format: str = "parquet") -> DataFrame:
    """A raw table with its declared schema; bad JSON rows keep their text in _corrupt_record."""
    reader = spark.read.schema(SCHEMAS[name] + (", _corrupt_record STRING" if format == "json" else ""))
    return reader.format(format).load(f"{folder}/{name}")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir. Where that is unset, a local session (tests) has a temporary
    one and any other is refused, since its executors and driver would not see the same files."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        where = tempfile.mkdtemp(prefix="spark-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_storage_entries(spark: SparkSession, folder: str, durability: str | None = None) -> DataFrame:
    """Storage entries, stored by durability; asking for one reads only its files."""
    out = read_table(spark, folder, "storage_entries")
    return out.where(F.col("durability") == durability) if durability else out


def read_simulations(spark: SparkSession, folder: str) -> DataFrame:
    """Simulation results from JSON lines; rows that do not parse keep their text in _corrupt_record."""
    return read_table(spark, folder, "simulations", "json")


def store_by_ledger(df: DataFrame, path: str, column: str = "ledger", width: int = 100_000) -> None:
    """A table partitioned by ledger bucket, as read_ledger_range expects it."""
    df.withColumn("bucket", F.floor(F.col(column) / width)).repartition("bucket").write.partitionBy("bucket").parquet(path)


def store_by_hash(df: DataFrame, path: str, key: str, buckets: int = 1024) -> None:
    """A table partitioned by the hash of a key without order, as read_matching expects it."""
    df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).repartition("bucket").write.partitionBy("bucket").parquet(path)


def read_matching(archive: DataFrame, batch: DataFrame, key: str, width: int | None = None, buckets: int = 1024, most: int = 10_000) -> DataFrame:
    """The rows of a bucketed archive (store_by_ledger on a numeric key with this width, or store_by_hash with so many
    buckets) whose key a batch has. Buckets that the batch does not touch are not opened: the touched ones are asked for
    first; beyond `most` of them the range that they span is read. The batch's keys are sent to where the archive is read
    if they are few enough, so that the archive is not shuffled."""
    keys = batch.select(key).where(F.col(key).isNotNull()).distinct()
    bucket = F.floor(F.col(key) / width).cast("bigint") if width else F.pmod(F.xxhash64(key), F.lit(buckets)).cast("bigint")
    mine = keys.select(bucket.alias("b")).distinct()
    touched = [r.b for r in mine.limit(most + 1).collect()]
    if len(touched) > most:
        low, high = mine.agg(F.min("b"), F.max("b")).first()
        near = F.col("bucket").between(low, high)
    else:
        near = F.col("bucket").isin(touched)
    rows = archive.where(near).drop("bucket")
    return rows.join(keys.withColumnRenamed(key, "_key"), F.col(key) == F.col("_key"), "left_semi")


def read_ledger_range(spark: SparkSession, path: str, schema: str, low: int, high: int, column: str = "ledger", width: int = 100_000) -> DataFrame:
    """Rows of a ledger range out of a table stored by ledger bucket: other buckets are not opened."""
    rows = spark.read.schema(schema + ", bucket BIGINT").parquet(path)
    return rows.where(F.col("bucket").between(low // width, high // width) & F.col(column).between(low, high)).drop("bucket")


def read_contract_events(events: DataFrame, low: int, high: int, types=None, contracts=None) -> DataFrame:
    """Events of a ledger range, optionally of some types and contracts; the filters reach the scan."""
    out = events.where(F.col("ledger").between(low, high))
    if types:
        out = out.where(F.col("type").isin(*types))
    return out.where(F.col("contract_id").isin(*contracts)) if contracts else out


def read_stored_events(spark: SparkSession, path: str, low: int, high: int, types=None, contracts=None) -> DataFrame:
    """read_contract_events on a table stored by ledger bucket."""
    return read_contract_events(read_ledger_range(spark, path, SCHEMAS["contract_events"], low, high), low, high, types, contracts)


def write_summary(df: DataFrame, path: str, partitions: list[str]) -> None:
    """A summary, stored by the values of partitions: writing rows of a partition again replaces it, so that a repeated
    run leaves the table as one run would, and partitions that df does not touch stay."""
    if not partitions:
        df.write.mode("overwrite").parquet(path)
        return
    df.repartition(*partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)
