"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from .ann import op4_ann
from .bpe import op6_bpe
from .decontamination import op1_decontamination
from .divergence import OP13_SQL, op13_divergence
from .html_text import op7_html_text
from .negatives import OP12_SQL, op12_negatives
from .packing import op11_packing
from .secrets import op3_secrets
from .sharding import op9_sharding
from .simhash import op5_simhash
from .toxicity import op8_toxicity
from .url_filter import OP10_SQL, op10_url_filter
from .warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_warc": op2_warc,
    "op3_secrets": op3_secrets,
    "op4_ann": op4_ann,
    "op5_simhash": op5_simhash,
    "op6_bpe": op6_bpe,
    "op7_html_text": op7_html_text,
    "op8_toxicity": op8_toxicity,
    "op9_sharding": op9_sharding,
    "op10_url_filter": op10_url_filter,
    "op11_packing": op11_packing,
    "op12_negatives": op12_negatives,
    "op13_divergence": op13_divergence,
}

ORACLE_SQL = {"op2_warc": OP2_SQL, "op10_url_filter": OP10_SQL, "op12_negatives": OP12_SQL, "op13_divergence": OP13_SQL}
