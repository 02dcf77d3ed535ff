"""Many fixed patterns in every text at once."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Patterns of one automaton, and their bytes: it is sent to every task.
MAX_PATTERNS, MAX_PATTERN_BYTES = 10_000, 16 << 20


def find_patterns(docs: DataFrame, patterns: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, first_at) of each pattern (item_id, pattern) that a text holds, with its first place from 1.

    Texts are read once, whatever the number of patterns. Null texts and null or empty patterns hold nothing; patterns
    beyond MAX_PATTERNS, or MAX_PATTERN_BYTES in all, are an error before any text is read.
    """
    whole = patterns.filter("pattern <> ''").select("item_id", "pattern")
    size = whole.limit(MAX_PATTERNS + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0)).alias("bytes")).first()
    if size["n"] > MAX_PATTERNS or size["bytes"] > MAX_PATTERN_BYTES:
        raise ValueError(f"at most {MAX_PATTERNS} patterns of {MAX_PATTERN_BYTES} bytes in all")
    named: dict[str, list] = {}
    for row in whole.collect():
        named.setdefault(row["pattern"], []).append(row["item_id"])
    id_type, item_type = dict(docs.dtypes)[id_col], dict(whole.dtypes)["item_id"]
    schema = f"doc_id {id_type}, item_id {item_type}, first_at long"

    def run(batches):
        import ahocorasick
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        fields = to_arrow_schema(StructType.fromJson(wanted))
        machine = ahocorasick.Automaton()
        for pattern in named:
            machine.add_word(pattern, pattern)
        machine.make_automaton()
        for batch in batches if named else ():
            found: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                first: dict[str, int] = {}
                for end, pattern in machine.iter(text.as_py() or ""):
                    first.setdefault(pattern, end - len(pattern) + 2)
                found += [(doc, item, at) for pattern, at in first.items() for item in named[pattern]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True) if found else ((), (), ()), fields, strict=True)], schema=fields)

    from pyspark.sql.types import _parse_datatype_string

    wanted = _parse_datatype_string(schema).jsonValue()
    return docs.select(id_col, text_col).mapInArrow(run, schema)
