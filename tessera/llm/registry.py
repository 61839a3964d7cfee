"""Names of this subpackage's queries, with their DuckDB oracles (none where SQL can't express the operator)."""

import corpus_pipeline

from . import digest, htmltext, langid, linededup, media, packing, pii, piecetokens, simhash, substrings

QUERIES = {
    "op1_langid": langid.query,
    "op2_pii": pii.query,
    "op3_linededup": linededup.query,
    "op4_digest": digest.query,
    "op5_piecetokens": piecetokens.query,
    "op6_simhash": simhash.query,
    "op7_substrings": substrings.query,
    "op8_packing": packing.query,
    "op9_media": media.query,
    "op10_htmltext": htmltext.query,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
