"""The registered queries of the training-data operators and the SQL they are compared with."""

from __future__ import annotations

from .chat_format import OP7_SQL, op7_chat_format
from .decontaminate import op3_decontaminate
from .html_extract import op6_html_extract
from .license_scan import OP2_SQL, op2_license_scan
from .packing import op9_best_fit_packing
from .quality_classifier import op10_quality_classifier
from .quality_rules import OP1_SQL, op1_quality_rules
from .simhash_dedup import op5_simhash_dedup
from .url_filter import op4_url_filter
from .warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_license_scan": op2_license_scan,
    "op3_decontaminate": op3_decontaminate,
    "op4_url_filter": op4_url_filter,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_html_extract": op6_html_extract,
    "op7_chat_format": op7_chat_format,
    "op8_warc": op8_warc,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_quality_classifier": op10_quality_classifier,
}

#: Queries that SQL can't express (models, fingerprint components, HTML, packing) are tested against brute force instead.
SQL = {"op1_quality_rules": OP1_SQL, "op2_license_scan": OP2_SQL, "op7_chat_format": OP7_SQL, "op8_warc": OP8_SQL}
