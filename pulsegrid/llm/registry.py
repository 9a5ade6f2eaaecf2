"""The corpus queries and their SQL, for the entry module."""

from __future__ import annotations

from . import bpe_words, chunkdedup, decontam, langid, linededup, ngramjoin, quality, sstable, suffixdedup, warc

QUERIES = {
    "op1_decontamination": decontam.query,
    "op2_ngram_join": ngramjoin.query,
    "op2_ngram_links": ngramjoin.query_links,
    "op3_quality": quality.query,
    "op4_bpe_words": bpe_words.query,
    "op5_sstable": sstable.query,
    "op6_suffix_dedup": suffixdedup.query,
    "op7_langid": langid.query,
    "op8_line_dedup": linededup.query,
    "op9_chunk_dedup": chunkdedup.query,
    "op10_warc_fixity": warc.query,
}

#: DuckDB SQL, for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": ngramjoin.ORACLE,
    "op2_ngram_links": ngramjoin.ORACLE_LINKS,
    "op3_quality": quality.ORACLE,
    "op6_suffix_dedup": suffixdedup.ORACLE,
    "op8_line_dedup": linededup.ORACLE,
}
