"""Schemas and fixed codes of the sample table and of raw recordings."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _I, _B, _H = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType(), T.BooleanType(), T.ShortType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in fields])


GAZE = ("gxL", "gyL", "paL", "gxR", "gyR", "paR")
RAW_PUPIL = ("pupxL", "pupyL", "pupxR", "pupyR")
FIXATION = ("in_fix", "fix_gavx", "fix_gavy", "fix_ava", "fix_dur")
SACCADE = ("in_sacc", "sacc_gstx", "sacc_gsty", "sacc_genx", "sacc_geny", "sacc_dur", "sacc_ampl", "sacc_pvel")
BLINK = ("in_blink", "blink_dur")
MICROSACCADE = ("in_msacc", "msacc_dx", "msacc_dy", "msacc_ampl", "msacc_pvel")

#: The canonical sample table.
SAMPLES = _struct(
    ("recording_id", _S), ("sample_idx", _L), ("time", _D), ("trial", _L), ("participant", _S),
    *((c, _D) for c in (*GAZE, *RAW_PUPIL)), ("message", _S),
    ("in_fix", _B), ("fix_gavx", _D), ("fix_gavy", _D), ("fix_ava", _D), ("fix_dur", _I),
    ("in_sacc", _B), ("sacc_gstx", _D), ("sacc_gsty", _D), ("sacc_genx", _D), ("sacc_geny", _D), ("sacc_dur", _I), ("sacc_ampl", _D), ("sacc_pvel", _D),
    ("in_blink", _B), ("blink_dur", _I),
)

#: Columns that belong to samples and are no trial variables.
SAMPLE_COLUMNS = frozenset(SAMPLES.names) | frozenset(MICROSACCADE) | {"time_rel", "diaxL", "diayL", "diaxR", "diayR", "crxL", "cryL", "crxR", "cryR", "hxL", "hyL", "hxR", "hyR", "rx", "ry", "flags", "input", "errors"}

#: Raw samples of a binary recording.
RAW_SAMPLES = _struct(("recording_id", _S), ("sample_idx", _L), ("time", _L), *((c, _D) for c in ("gxR", "gyR", "paR", "gxL", "gyL", "paL", "hxR", "hyR", "hxL", "hyL", "rx", "ry")), ("flags", _I), ("input", _I), ("errors", _I), ("trial", _L))

#: Raw events; 35 columns after the key and the file order.
EVENTS = _struct(
    ("recording_id", _S), ("event_seq", _L), ("time", _L), ("type", _H), ("read", _I), ("sttime", _L), ("entime", _L), ("eye", _H), ("status", _I), ("flags", _I), ("input", _I), ("buttons", _I), ("parsedby", _I), ("message", _S),
    *((c, _D) for c in "hstx hsty gstx gsty sta henx heny genx geny ena havx havy gavx gavy ava ampl pvel svel evel supd_x eupd_x supd_y eupd_y".split()),
)

#: Recording blocks.
RECORDINGS = _struct(("recording_id", _S), ("time", _L), ("sample_rate", _D), ("eflags", _I), ("sflags", _I), *((c, _H) for c in ("state", "record_type", "pupil_type", "recording_mode", "filter_type", "pos_type", "eye")), ("trial", _L))

# Event codes of the vendor's format, and eyes.
START_PARSE, END_PARSE, BREAK_PARSE = 1, 2, 10
START_BLINK, END_BLINK, START_SACC, END_SACC, START_FIX, END_FIX, FIX_UPDATE = 3, 4, 5, 6, 7, 8, 9
START_SAMPLES, END_SAMPLES, START_EVENTS, END_EVENTS = 15, 16, 17, 18
MESSAGE, BUTTON, INPUT, LOST_DATA, SAMPLE, RECORDING_INFO = 24, 25, 28, 0x3F, 200, 30
LEFT, RIGHT, BINOCULAR = 0, 1, 2
RECORDING_END, RECORDING_START = 0, 1
TRIAL_START_MARKER, TRIAL_END_MARKER = "TRIALID", "TRIAL_RESULT"
