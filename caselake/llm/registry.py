"""The queries of this subpackage and their SQL."""

from . import bpe, exact_dedup, html_extract, line_dedup, ngram_join, packing, progressive_jpeg, quality_crf, suffix_dedup, warc_fixity

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_warc_fixity": warc_fixity.op2_warc_fixity,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_packing": packing.op4_packing,
    "op5_quality_crf": quality_crf.op5_quality_crf,
    "op6_progressive_jpeg": progressive_jpeg.op6_progressive_jpeg,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_html_extract": html_extract.op10_html_extract,
}
ORACLES = {"op1_exact_dedup": exact_dedup.ORACLE, "op2_warc_fixity": warc_fixity.ORACLE}
