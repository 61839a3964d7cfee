"""What each component gives the growth engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_S, _D, _B = T.StringType(), T.DoubleType(), T.BooleanType()


def _of(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


CONTRACTS = {
    "opportunity_view": _of(channel=_S, score=_D, confidence=_D, top_feature=_S),
    "jsd_contrib": _of(channel=_S, topic=_S, part=_D, gap=_D),
    "bridge_score": _of(channel=_S, ppr=_D, topic_similarity=_D, confidence=_D, score=_D),
    "emerging_flag": _of(topic=_S, changepoint_p=_D, rise=_D, emerging=_B),
}


def validated(df: DataFrame, name: str) -> DataFrame:
    """df, if it is of the component's contract (columns, order and types; not nullability)."""
    want, got = [(f.name, f.dataType) for f in CONTRACTS[name]], [(f.name, f.dataType) for f in df.schema]
    if want != got:
        raise ValueError(f"{name} breaks its contract: {got}")
    return df
