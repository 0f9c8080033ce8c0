"""Layout of one signalling record and the numeric codes it carries."""

from __future__ import annotations

# 1-based position of each field in a `;`-separated record line.
FIELD_POSITION = {
    "proc_id": 7,
    "start_ms": 8,
    "rec_seq": 9,
    "serv_init_num": 10,
    "proc_duration": 11,
    "cfc": 12,
    "cfcq": 13,
    "scfcq": 14,
    "imsi": 18,
    "cur_cell": 21,
    "sgw": 38,
    "prev_cell": 41,
    "stop_ms": 87,
    "ul_init_bler": 92,
    "ul_res_bler": 93,
    "intra_start": 101,
    "intra_status": 102,
    "x2_start": 103,
    "x2_status": 104,
    "s1_start": 105,
    "s1_status": 106,
    "source_cell": 131,
    "target_cell": 132,
    "mob_trigger": 137,
    "dl_init_bler": 143,
    "dl_res_bler": 144,
}
FIRST_MEASURED_FIELD = 251
STATION_CODE_LENGTH = 13

FIELD_TYPE = {
    "proc_id": "int",
    "start_ms": "bigint",
    "rec_seq": "bigint",
    "serv_init_num": "int",
    "proc_duration": "int",
    "cfc": "int",
    "cfcq": "string",
    "scfcq": "string",
    "imsi": "string",
    "cur_cell": "string",
    "sgw": "string",
    "prev_cell": "string",
    "stop_ms": "bigint",
    "ul_init_bler": "int",
    "ul_res_bler": "int",
    "intra_start": "bigint",
    "intra_status": "int",
    "x2_start": "bigint",
    "x2_status": "int",
    "s1_start": "bigint",
    "s1_status": "int",
    "source_cell": "string",
    "target_cell": "string",
    "mob_trigger": "int",
    "dl_init_bler": "int",
    "dl_res_bler": "int",
}

# Procedure ids.
CTX_RELEASE_REQ = 11
DEL_BEARER_REQ = 3
INIT_ATTACH = 1
UE_INIT_SERVE_REQ = 16
PAGING = 15
CSFB_PROCEDURE = 36

RELEASE_PROCEDURES = (CTX_RELEASE_REQ, DEL_BEARER_REQ)
ATTEMPT_PROCEDURES = (INIT_ATTACH, UE_INIT_SERVE_REQ, PAGING)

# Circuit-switched fallback is trigger 3; code 100 is success.
CSFB_TRIGGER = 3
CSFB_SUCCESS = 100
# A completion code above this is a failure.
LAST_GOOD_CFC = 1
