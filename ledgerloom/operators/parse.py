"""Model replies to typed invoice records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.errors import MODEL_ERROR, error, no_error
from ledgerloom.functions.money import MONEY_SQL, clean_money
from ledgerloom.functions.text import WHITESPACE_CLASS, strip
from ledgerloom.operators.settle import settle
from ledgerloom.schemas import COUNTRIES, TOKEN_USAGE_SQL, RecordSchema

_ENVELOPE = (
    "message struct<content:string>, prompt_eval_count bigint, eval_count bigint, "
    "total_duration bigint, _broken string"
)
def clean_json(content: Column) -> Column:
    """The JSON object of a reply: fenced, else first to last brace, else all."""
    text = strip(content)
    ws = f"{WHITESPACE_CLASS}*"
    fenced = F.regexp_extract(text, rf"(?s)```(?:json)?{ws}(\{{.*?\}}){ws}```", 1)
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return strip(
        F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(braces, F.lit("")), text)
    )


def _raw_sql(schema: RecordSchema) -> str:
    """Struct with every field still a variant: null when absent."""
    return f"struct<{','.join(f'{name}:variant' for name in schema.order)}>"


def _as(value: Column, sql_type: str) -> Column:
    return F.try_variant_get(value, "$", sql_type)


def _text_field(value: Column, name: str, schema: RecordSchema) -> tuple[Column, Column]:
    """Value and, when its type is wrong, the field's name."""
    kind = F.schema_of_variant(value)
    text = _as(value, "string")
    wrong = ~kind.isin("STRING", "VOID")
    if name in schema.text_or_int:
        number = _as(value, "decimal(38,18)")
        is_flag = kind == "BOOLEAN"
        is_whole = (kind != "STRING") & ~is_flag & (number == F.floor(number))
        text = (
            F.when(is_whole, F.floor(number).cast("string"))
            .when(is_flag, _as(value, "boolean").cast("int").cast("string"))
            .otherwise(text)
        )
        wrong = wrong & ~F.coalesce(is_whole | is_flag, F.lit(False))
    if name in schema.defaults:
        text = F.when(value.isNull(), F.lit(schema.defaults[name])).otherwise(text)
    return text, F.when(wrong, F.lit(name))


def _money_field(value: Column, name: str) -> tuple[Column, Column]:
    """A JSON number is taken as it is, a JSON string is cleaned, all else is null.

    A number that the money type can't hold is wrong, in either form.
    """
    kind = F.schema_of_variant(value)
    text = _as(value, "string")
    amount = F.when(kind == "STRING", clean_money(text)).when(
        kind != "BOOLEAN", _as(value, MONEY_SQL)
    )
    is_number = F.when(kind == "STRING", text.rlike(r"\p{Nd}")).otherwise(
        (kind != "BOOLEAN") & _as(value, "double").isNotNull()
    )
    return amount, F.when(is_number & amount.isNull(), F.lit(name))


def _fields(raw: Column, schema: RecordSchema) -> tuple[dict[str, Column], list[Column]]:
    """Values and type problems of the fields that are no lists."""
    values: dict[str, Column] = {}
    problems: list[Column] = []
    for name in schema.order:
        if name in schema.lists:
            continue
        if name in schema.money:
            value, problem = _money_field(raw[name], name)
        else:
            value, problem = _text_field(raw[name], name, schema)
        values[name] = value.alias(name)
        problems.append(problem)
    return values, problems


def _parsed_list(value: Column, name: str, schema: RecordSchema) -> Column:
    """Elements of a list as ``struct<data, problems>``, null if it is no list."""
    raw_rows = F.transform(_as(value, "array<variant>"), lambda v: _as(v, _raw_sql(schema)))

    def element(raw: Column, i: Column) -> Column:
        place = F.concat(F.lit(f"{name}."), i.cast("string"))
        values, problems = _fields(raw, schema)
        inner = F.transform(
            F.array_compact(F.array(*problems)), lambda p: F.concat(place, F.lit("."), p)
        )
        return F.struct(
            F.struct(*values.values()).alias("data"),
            # An element that is no object has no raw struct.
            F.when(raw.isNotNull(), inner).otherwise(F.array(place)).alias("problems"),
        )

    return F.transform(raw_rows, element)


def read_records(rows: DataFrame, json: str, schema: RecordSchema) -> DataFrame:
    """Adds ``data`` and ``problems``; the JSON text is parsed once per row.

    ``problems`` lists the paths that break the strict types; a text that is
    no JSON object has the single problem ``$``. Each step is a projection of
    its own, so lists and problems are computed once and used twice.
    """
    # The parser stops after one value. The text stands in an array before its
    # own hash: whatever follows the object breaks the JSON or takes the place
    # of the hash.
    mark = F.xxhash64(F.col(json))
    marked = F.concat(F.lit("["), F.col(json), F.lit(","), mark.cast("string"), F.lit("]"))
    root = F.col("_root")
    is_whole = (F.size(root) == 2) & (_as(F.get(root, F.lit(1)), "bigint") == mark)
    raw = F.col("_raw")
    lists = {name: f"_list_{name}" for name in schema.lists}
    parsed = (
        rows.withColumn("_root", _as(F.try_parse_json(marked), "array<variant>"))
        .withColumn("_raw", F.when(is_whole, _as(F.get(root, F.lit(0)), _raw_sql(schema))))
        .withColumns({c: _parsed_list(raw[n], n, schema.lists[n]) for n, c in lists.items()})
    )

    values, field_problems = _fields(raw, schema)
    no_problems = F.array().cast("array<string>")
    found = [F.array_compact(F.array(*field_problems))]
    for name, column in lists.items():
        found.append(
            F.when(
                F.col(column).isNotNull(),
                F.flatten(F.transform(column, lambda e: e["problems"])),
            )
            .when(raw[name].isNotNull(), F.array(F.lit(name)))
            .otherwise(no_problems)
        )
        empty = F.array().cast(f"array<{schema.lists[name].sql()}>")
        values[name] = F.coalesce(F.transform(column, lambda e: e["data"]), empty).alias(name)
    problems = F.when(raw.isNotNull(), F.concat(*found)).otherwise(F.array(F.lit("$")))
    data = F.struct(*[values[n] for n in schema.order])
    return (
        parsed.withColumn("problems", problems)
        .withColumn("data", F.when(F.size("problems") == 0, data))
        .drop("_root", "_raw", *lists.values())
    )


def read_envelopes(responses: DataFrame, model: str = "gemma2:2b") -> DataFrame:
    """Splits reply bodies into ``json``, ``token_usage`` and ``error``.

    ``responses`` holds ``http_status`` and ``body``, and may hold ``failure``
    for calls that gave no reply at all.
    """
    envelope = F.from_json(
        F.col("body"), _ENVELOPE, {"columnNameOfCorruptRecord": "_broken"}
    )
    rows = responses.withColumn("_env", F.when(F.col("http_status") == 200, envelope))
    inputs = F.coalesce(F.col("_env.prompt_eval_count"), F.lit(0))
    outputs = F.coalesce(F.col("_env.eval_count"), F.lit(0))
    usage = F.struct(
        inputs.alias("input_tokens"),
        outputs.alias("output_tokens"),
        F.lit(None).cast("bigint").alias("thoughts_tokens"),
        (inputs + outputs).alias("total_tokens"),
        F.expr("coalesce(_env.total_duration, 0) div 1000000").alias("execution_time_ms"),
        F.lit(model).alias("model"),
    )

    no_object = F.col("_env._broken").isNotNull() | ~F.ltrim("body").startswith("{")
    failure = F.col("failure") if "failure" in responses.columns else F.lit(None).cast("string")
    # Statuses and messages of failed model calls.
    problem = (
        F.when(
            failure == "connect",
            error(503, MODEL_ERROR, "Could not connect to Ollama. Ensure Ollama is running."),
        )
        .when(failure == "timeout", error(504, MODEL_ERROR, "Ollama extraction timed out"))
        .when(
            failure.isNotNull(),
            error(502, MODEL_ERROR, F.concat(F.lit("Ollama request failed: "), failure)),
        )
        .when(
            ~(F.coalesce(F.col("http_status"), F.lit(0)) == 200),
            error(
                502,
                MODEL_ERROR,
                F.concat(
                    F.lit("Ollama returned HTTP "),
                    F.coalesce(F.col("http_status").cast("string"), F.lit("0")),
                    F.lit(": "),
                    F.coalesce(F.substring("body", 1, 200), F.lit("")),
                ),
            ),
        )
        .when(
            F.coalesce(no_object, F.lit(True)),
            error(500, "internal_error", "An unexpected error occurred: reply is not JSON"),
        )
        .otherwise(no_error())
    )
    rows = rows.withColumn("error", problem)
    ok = F.col("error").isNull()
    content = F.coalesce(F.col("_env.message.content"), F.lit(""))
    return rows.withColumns(
        {
            "json": F.when(ok, clean_json(content)),
            "token_usage": F.when(ok, usage.cast(TOKEN_USAGE_SQL)),
        }
    ).drop("_env")


def parse_replies(responses: DataFrame, country: str, model: str = "gemma2:2b") -> DataFrame:
    """Replies of one country to ``data``, ``token_usage`` and ``error``."""
    records = read_records(read_envelopes(responses, model), "json", COUNTRIES[country])
    rejected = F.col("error").isNull() & (F.size("problems") > 0)
    detail = F.concat(
        F.lit("Gemma output validation failed: "), F.array_join("problems", ", ")
    )
    checked = records.withColumn(
        "error", F.when(rejected, error(422, MODEL_ERROR, detail)).otherwise(F.col("error"))
    )
    ok = F.col("error").isNull()
    typed = checked.withColumns(
        {
            "data": F.when(ok, F.col("data")),
            "token_usage": F.when(ok, F.col("token_usage")),
        }
    ).drop("json", "problems", "http_status", "body", "failure")
    return settle(typed, "data", "token_usage", "error")
