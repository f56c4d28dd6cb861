"""The scalar functions by name in SQL, as temporary SQL functions over built-in expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

SCORES = "CASE WHEN length(q) > 0 THEN transform(split(q, ''), c -> ascii(c) - 33) ELSE CAST(array() AS ARRAY<INT>) END"

FUNCTIONS = {
    "phred_scores(q STRING) RETURNS ARRAY<INT>": SCORES,
    "phred_string(s ARRAY<INT>) RETURNS STRING": "array_join(transform(s, x -> char(x + 33)), '')",
    "count_n(s STRING) RETURNS INT": "length(s) - length(translate(s, 'Nn', ''))",
    "share_n(s STRING) RETURNS DOUBLE": "CASE WHEN length(s) > 0 THEN (length(s) - length(translate(s, 'Nn', ''))) / length(s) ELSE 0D END",
    "mean_score(q STRING) RETURNS DOUBLE": f"CASE WHEN length(q) > 0 THEN aggregate({SCORES}, 0, (a, x) -> a + x) / length(q) END",
    "error_sum(q STRING) RETURNS DOUBLE": f"aggregate({SCORES}, 0D, (a, x) -> a + pow(10D, -x / 10D))",
    "complement(s STRING) RETURNS STRING": "translate(s, 'ACGTNacgtn', 'TGCANtgcan')",
    "reverse_complement(s STRING) RETURNS STRING": "reverse(translate(s, 'ACGTNacgtn', 'TGCANtgcan'))",
    "hamming(a STRING, b STRING) RETURNS INT": "aggregate(zip_with(split(a, ''), split(b, ''), (x, y) -> CASE WHEN x <> y THEN 1 ELSE 0 END), 0, (s, x) -> s + x)",
    "umi(s STRING, n INT) RETURNS STRING": "CASE WHEN length(s) >= n THEN upper(substring(s, -n, n)) END",
    "decimal_text(x DOUBLE) RETURNS STRING": "format_number(x, '###,###.#######')",
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to spark.sql in this session; gives their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
