"""The queries and SQL of this subpackage."""

from importlib import import_module

MODULES = ("op1_surrogates", "op2_urls", "op3_mixing", "op4_transport", "op5_anchors", "op6_decisions", "op7_factors", "op8_chat", "op9_jaccard", "op10_bpe")


def modules():
    return [import_module(f"{__package__}.{m}") for m in MODULES]


def queries() -> dict:
    import corpus_pipeline

    return {m.NAME: m.query for m in modules()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {m.NAME: m.oracle() for m in modules() if hasattr(m, "oracle")}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
