"""Operation catalog, typed linear pipelines and batches with failures as rows."""

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_INPUTS, MAX_RETRIES = 500, 3


@dataclass(frozen=True)
class Operation:
    """What an operation takes and gives; ``many`` outputs have no fixed number."""

    id: str
    takes: str
    gives: str
    least: int = 1
    most: int = 1
    many: bool = False
    terminal: bool = False
    pipeline: bool = True
    batch: bool = True
    sidecars: tuple[str, ...] = ()
    engine: str = "wasm"


def _ops(kind: str, gives: str, names: str, **more) -> list[Operation]:
    return [Operation(n, kind, gives, **more) for n in names.split()]


_PLAIN = {"terminal": True, "pipeline": False}
_PAGE = _PLAIN | {"batch": False}
#: What each operation takes, gives and can be used in.
CATALOG: dict[str, Operation] = {
    o.id: o
    for o in [
        *_ops("pdf", "pdf", "merge", least=2, most=100),
        *_ops("pdf", "pdf", "interleave", least=2, most=2),
        *_ops("pdf", "pdf", "remove blank rotate crop resize nup watermark pagenum compress flatten metadata unlock"),
        *_ops("pdf", "pdf", "protect", terminal=True),
        *_ops("pdf", "pdf", "reorder", batch=False),
        *_ops("pdf", "pdf", "stamp", sidecars=("image",)),
        *_ops("pdf", "pdf", "split", many=True, **_PLAIN),
        *_ops("pdf", "text", "pdftext", **_PLAIN),
        *_ops("pdf", "json", "info", **_PLAIN),
        *_ops("pdf", "zip", "pdfimages", **_PLAIN),
        *_ops("pdf", "zip", "pdf2img", engine="module", **_PLAIN),
        *_ops("pdf", "text", "pdfdiff", least=2, most=2, **_PAGE),
        *_ops("pdf", "docx", "pdf2docx", **_PLAIN),
        *_ops("pdf", "hwpx", "pdf2hwpx", **_PLAIN),
        *_ops("image", "pdf", "img2pdf", most=500),
        *_ops("image", "image", "imgconv imgresize"),
        *_ops("text", "pdf", "txt2pdf md2pdf"),
        *_ops("docx", "pdf", "docx2pdf"),
        *_ops("docx", "hwpx", "docx2hwpx", **_PLAIN),
        *_ops("hwpx", "pdf", "hwpx2pdf"),
        *_ops("hwpx", "docx", "hwpx2docx", **_PLAIN),
        *_ops("hwp", "pdf", "hwp2pdf"),
        *_ops("xlsx", "csv", "xlsx2csv", **_PLAIN),
        *_ops("file", "pdf", "ocrpdf", most=500, **_PAGE),
        *_ops("file", "text", "ocr", most=500, engine="module", **_PLAIN),
        *_ops("raster-pages", "pdf", "redact", most=500, **_PAGE),
        *_ops("file", "file", "send", most=1000, many=True, engine="transport", **_PAGE),
        *_ops("pdf", "pdf", "workflow", most=100, engine="module", **_PAGE),
        *_ops("pdf", "pdf", "batch", most=500, many=True, engine="module", **_PAGE),
        *_ops("text", "pdf", "typst", engine="module", pipeline=False, batch=False),
        *_ops("text", "text", "mdedit", pipeline=False, batch=False),
        *_ops("text", "text", "htmledit", engine="module", pipeline=False, batch=False),
    ]
}


@dataclass
class Step:
    id: str
    operation: str
    params: dict = field(default_factory=dict)
    sidecars: tuple[str, ...] = ()


class PlanError(ValueError):
    """A pipeline that can't be run; raised before any work starts."""


def validate(steps: list[Step], kind: str, count: int, catalog: dict[str, Operation] = CATALOG) -> tuple[str, int | None]:
    """Kind and number (null: unknown) of what a pipeline gives; PlanError if its steps don't fit together."""
    if not steps or count < 1:
        raise PlanError("a pipeline needs steps and input")
    if len({s.id for s in steps}) != len(steps):
        raise PlanError("steps need distinct ids")
    number: int | None = count
    for k, s in enumerate(steps):
        op = catalog.get(s.operation)
        if op is None:
            raise PlanError(f"no operation {s.operation}")
        if op.terminal and k < len(steps) - 1:
            raise PlanError(f"{op.id} must come last")
        if not op.pipeline:
            raise PlanError(f"{op.id} is not available in pipelines")
        if op.takes != kind:
            raise PlanError(f"{op.id} takes {op.takes}, not {kind}")
        if number is None or not op.least <= number <= op.most:
            raise PlanError(f"{op.id} takes {op.least} to {op.most} inputs")
        if missing := set(op.sidecars) - set(s.sidecars):
            raise PlanError(f"{op.id} needs {', '.join(sorted(missing))}")
        kind, number = op.gives, None if op.many else 1
    return kind, number


def run(data: DataFrame, steps: list[Step], handlers: dict[str, Callable[..., DataFrame]], kind: str = "pdf", count: int = 1, catalog: dict[str, Operation] = CATALOG) -> DataFrame:
    """Validated steps as one lazy plan."""
    validate(steps, kind, count, catalog)
    for s in steps:
        data = data.transform(handlers[s.operation], **s.params)
    return data


def artifact_key(step: Step, inputs: list[str], sidecars: dict[str, str] | None = None) -> str:
    """Names a step's result by its operation, parameters and the digests of what it reads: the same for the same work."""
    said = {"operation": step.operation, "params": step.params, "inputs": inputs, "sidecars": sidecars or {}}
    return hashlib.sha256(json.dumps(said, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def as_table(spark: SparkSession, catalog: dict[str, Operation] = CATALOG) -> DataFrame:
    rows = [(o.id, o.takes, o.least, o.most, o.gives, o.many, o.terminal, o.pipeline, o.batch) for o in catalog.values()]
    return spark.createDataFrame(rows, "id string, takes string, least int, most int, gives string, many boolean, terminal boolean, pipeline boolean, batch boolean")


def attempt(function: Callable[[bytes], bytes], data: Column, retries: int = 0) -> Column:
    """Apply a Python function to binary rows; errors become struct(ok, value, error, attempts), never a failed job."""
    if not 0 <= retries <= MAX_RETRIES:
        raise ValueError("at most 3 retries")
    @F.pandas_udf("struct<ok: boolean, value: binary, error: string, attempts: int>")
    def tried(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            for n in range(1, retries + 2):
                try:
                    row = (True, function(v), None, n)
                    break
                except Exception as e:  # noqa: BLE001  a row's failure is its result
                    row = (False, None, str(e), n)
            rows.append(row)
        return pd.DataFrame(rows, columns=["ok", "value", "error", "attempts"])

    return tried(data)


def summarise(results: DataFrame, keys: list[str]) -> DataFrame:
    """inputs, succeeded, failed and the failures in order of ``index``, of rows (index, ok)."""
    bad = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("index"))))
    return results.groupBy(*keys).agg(F.count("*").alias("inputs"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), bad.alias("failures"))
