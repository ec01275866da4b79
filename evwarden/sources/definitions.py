"""Operation, transaction and workload documents, and the checks on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NAMED = "array<struct<name: string, type: string>>"
_PAIRS = "array<struct<key: string, value: string>>"

OPERATION = (
    f"templateId string, type string, httpMethod string, url string, arguments {_NAMED}, dynamicVariables {_NAMED}, "
    f"headers {_PAIRS}, queryParameters {_PAIRS}, requestPayload struct<type: string, content: string>, "
    "response struct<payload: struct<type: string, returnValues: array<struct<key: string, value: string, type: string>>>>, "
    "duration string, units string"
)
TRANSACTION = (
    f"templateId string, arguments {_NAMED}, dynamicVariables {_NAMED}, "
    "operations array<struct<operationReferenceId: string, id: string>>"
)
WORKLOAD = (
    "templateId string, maxConcurrentTransactions int, "
    "generators array<struct<id: string, type: string, distribution: string, constant: string, start: int, min: int, "
    "max: int, sampleSpace: array<string>, exponent: double>>, "
    "transactions array<struct<id: string, transactionReferenceId: string, count: bigint, "
    "data: array<struct<name: string, generatorReferenceId: string>>>>"
)
_SCHEMAS = {"op": OPERATION, "tx": TRANSACTION, "workload": WORKLOAD}

# Fixed values of the document language.
_OPERATION_TYPES = ["http", "sleep"]
_METHODS = ["get", "post", "put", "patch", "delete"]
_UNITS = ["milliseconds", "seconds", "minutes"]
_GENERATOR_TYPES = ["unsignedint", "signedint", "string", "guid", "constant", "counter"]
_DISTRIBUTIONS = ["uniform", "zipfian"]
_ARGUMENT_TYPES = ["string", "number", "object", "array", "boolean", "null", "guid"]
_VARIABLE_TYPES = ["unsignedint", "signedint", "string", "guid"]


def read_definitions(spark: SparkSession, path: str) -> DataFrame:
    """Every ``*.json`` below ``path``: ``file, kind (op | tx | workload), text``."""
    docs = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .option("wholetext", True)
        .text(path)
        .select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    )
    return docs.withColumn("kind", F.regexp_extract("file", r"^(op|tx|workload)_", 1)).filter("kind <> ''")


def parse(docs: DataFrame, kind: str) -> DataFrame:
    """Documents of one kind with their fields as columns."""
    doc = F.from_json("text", _SCHEMAS[kind])
    return docs.filter(F.col("kind") == kind).select("file", doc.alias("d")).select("file", "d.*")


def definition_errors(operations: DataFrame, transactions: DataFrame, workloads: DataFrame) -> DataFrame:
    """``file, id, error``: required fields, allowed values, name clashes and broken references."""
    found = [
        _check(operations, _operation_rules()),
        _check(transactions, _transaction_rules()),
        _check(workloads, _workload_rules()),
        dangling(transactions, "operations", "operationReferenceId", operations, "unknown operation"),
        dangling(workloads, "transactions", "transactionReferenceId", transactions, "unknown transaction"),
        _unknown_generators(workloads),
        _clashing_variables(transactions, operations),
    ]
    return reduce(DataFrame.unionByName, found)


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def _no_items(c: Column) -> Column:
    return F.coalesce(F.size(c) == 0, F.lit(True))


def _outside(c: Column, allowed: list[str]) -> Column:
    return ~F.coalesce(F.lower(c).isin(allowed), F.lit(False))


def _any(c: Column, test) -> Column:
    return F.coalesce(F.exists(c, test), F.lit(False))


def shared_names(arguments: Column, variables: Column) -> Column:
    """Whether an argument and a dynamic variable have one name."""
    return F.coalesce(F.arrays_overlap(arguments["name"], variables["name"]), F.lit(False))


def _repeated(declared: Column) -> Column:
    """Whether a list of names holds one of them twice."""
    return F.coalesce(F.size(F.array_distinct(declared["name"])) < F.size(declared["name"]), F.lit(False))


def _operation_rules() -> dict[str, Column]:
    http, sleep = F.lower("type") == "http", F.lower("type") == "sleep"
    return {
        "templateId is empty": _blank(F.col("templateId")),
        "unknown operation type": _outside(F.col("type"), _OPERATION_TYPES),
        "url is empty": http & _blank(F.col("url")),
        "unknown http method": http & _outside(F.col("httpMethod"), _METHODS),
        "duration is empty": sleep & _blank(F.col("duration")),
        "unknown units": sleep & _outside(F.col("units"), _UNITS),
        "unknown argument type": _any(F.col("arguments"), lambda a: _outside(a["type"], _ARGUMENT_TYPES)),
        "unknown variable type": _any(F.col("dynamicVariables"), lambda a: _outside(a["type"], _VARIABLE_TYPES)),
        "argument and variable share a name": shared_names(F.col("arguments"), F.col("dynamicVariables")),
        "a name is declared twice": _repeated(F.col("arguments")) | _repeated(F.col("dynamicVariables")),
    }


def _transaction_rules() -> dict[str, Column]:
    return {
        "templateId is empty": _blank(F.col("templateId")),
        "no operations": _no_items(F.col("operations")),
        "operation id is empty": _any(F.col("operations"), lambda o: _blank(o["id"])),
        "operation reference is empty": _any(F.col("operations"), lambda o: _blank(o["operationReferenceId"])),
        "argument and variable share a name": shared_names(F.col("arguments"), F.col("dynamicVariables")),
        "a name is declared twice": _repeated(F.col("arguments")) | _repeated(F.col("dynamicVariables")),
    }


def _workload_rules() -> dict[str, Column]:
    return {
        "templateId is empty": _blank(F.col("templateId")),
        "no transactions": _no_items(F.col("transactions")),
        "transaction id is empty": _any(F.col("transactions"), lambda t: _blank(t["id"])),
        "transaction reference is empty": _any(F.col("transactions"), lambda t: _blank(t["transactionReferenceId"])),
        "count is missing": _any(F.col("transactions"), lambda t: F.coalesce(t["count"] == 0, F.lit(True))),
        "unknown generator type": _any(F.col("generators"), lambda g: _outside(g["type"], _GENERATOR_TYPES)),
        "unknown distribution": _any(
            F.col("generators"), lambda g: g["distribution"].isNotNull() & _outside(g["distribution"], _DISTRIBUTIONS)
        ),
    }


def _check(docs: DataFrame, rules: dict[str, Column]) -> DataFrame:
    errors = F.filter(
        F.array(*[F.when(broken, F.lit(text)) for text, broken in rules.items()]), lambda e: e.isNotNull()
    )
    return docs.select("file", F.col("templateId").alias("id"), F.explode(errors).alias("error"))


def dangling(docs: DataFrame, items: str, member: str, targets: DataFrame, error: str) -> DataFrame:
    """References of ``docs.items[].member`` that no ``targets.templateId`` answers."""
    refs = docs.select("file", F.col("templateId").alias("id"), F.explode(items).alias("item")).select(
        "file", "id", F.col(f"item.{member}").alias("ref")
    )
    known = targets.select(F.col("templateId").alias("ref")).filter("ref is not null")
    return (
        refs.filter(~_blank(F.col("ref")))
        .join(known, "ref", "left_anti")
        .select("file", "id", F.concat_ws(" ", F.lit(error), F.col("ref")).alias("error"))
    )


def _clashing_variables(transactions: DataFrame, operations: DataFrame) -> DataFrame:
    """Transactions with a variable whose name one of their operations declares as well."""
    own = transactions.select(
        "file", F.col("templateId").alias("id"), F.col("dynamicVariables.name").alias("names"), F.explode("operations").alias("op")
    ).select("file", "id", "names", F.col("op.operationReferenceId").alias("ref"))
    theirs = operations.select(F.col("templateId").alias("ref"), F.col("dynamicVariables.name").alias("others"))
    both = own.join(theirs, "ref").select("file", "id", F.explode(F.array_intersect("names", "others")).alias("name"))
    return both.distinct().select("file", "id", F.concat_ws(" ", F.lit("variable clashes with an operation's"), F.col("name")).alias("error"))


def _unknown_generators(workloads: DataFrame) -> DataFrame:
    """Only workloads that declare generators are checked."""
    used = F.flatten(F.transform("transactions", lambda t: F.coalesce(t["data"]["generatorReferenceId"], F.array())))
    unknown = F.array_except(used, F.col("generators.id"))
    return workloads.filter("generators is not null").select(
        "file", F.col("templateId").alias("id"), F.explode(unknown).alias("ref")
    ).select("file", "id", F.concat_ws(" ", F.lit("unknown generator"), F.col("ref")).alias("error"))


def missing_references(rows: DataFrame, column: str, targets: DataFrame, target_column: str) -> DataFrame:
    """Rows whose ``column`` points at nothing: the same check on large tables.

    One anti join against the distinct targets, so that Spark can divide the rows of a
    popular key at run time.  A null refers to nothing and is no broken reference.
    """
    known = targets.select(F.col(target_column).alias(column)).distinct()
    return rows.filter(F.col(column).isNotNull()).join(known, column, "left_anti")
