"""EyeLink binary recordings. A file is decoded by one task, record after record; files are decoded in parallel.

Fixed facts of the format are tables here: sizes of payloads, places of fields, and the order in which the fields of a
sample follow each other.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from gazeframe import schema as S
from gazeframe.frame import RecordingMeta
from gazeframe.operators.annotate import RawRecording
from gazeframe.sources.files import contents

END_OF_PREAMBLE = b"ENDP:\n"
MISSING = -32768
FULL_TIME, BOTH_BITS = 0x2000, (0x8000, 0x4000)
PLAUSIBLE = range(100, 2001)
CONTROL = {S.START_SAMPLES, S.END_SAMPLES, S.START_EVENTS, S.END_EVENTS}
KNOWN = CONTROL | {S.START_PARSE, S.END_PARSE, S.BREAK_PARSE, S.START_BLINK, S.END_BLINK, S.START_SACC, S.END_SACC, S.START_FIX, S.END_FIX, S.FIX_UPDATE, S.MESSAGE, S.BUTTON, S.INPUT, S.LOST_DATA}
#: Eye by the two high bits of a record's first byte.
EYES = (-1, S.RIGHT, S.LEFT, S.BINOCULAR)
#: Sample fields in file order: flag, names (per eye), format.
FIELDS = ((0x1000, ("px", "py"), True), (0x0800, ("hx", "hy"), True), (0x0400, ("gx", "gy"), True), (0x0200, ("rx", "ry"), False), (0x0100, ("pa",), True))
#: Payloads of eye events: size, and (offset, name) of big-endian int16 in tenths.
SACC_SIZE, FIX_SIZE = 48, 67
SACC_FIELDS = {"hstx": 5, "hsty": 7, "gstx": 11, "gsty": 13, "henx": 17, "heny": 19, "genx": 21, "geny": 23, "pvel": 35, "supd_x": 43, "supd_y": 45}
FIX_FIELDS = {"hstx": 5, "hsty": 7, "gavx": 11, "gavy": 13}
FIX_PUPIL = 36


@lru_cache(64)
def sample_layout(sflags: int) -> tuple[struct.Struct, tuple[str, ...], int | None]:
    """How a sample with these flags is unpacked: format, names, and where its input byte is."""
    eyes = [e for bit, e in zip(BOTH_BITS, "LR", strict=True) if sflags & bit]
    form, names = ">", []
    for bit, own, per_eye in FIELDS:
        if sflags & bit:
            for e in eyes if per_eye else [""]:
                names += [f"{n}{e}" for n in own]
                form += "h" * len(own)
    if sflags & 0x0040:
        names.append("status")
        form += "H"
    if sflags & 0x0080:
        names.append("input")
        form += "xB"
    form += "xx" * (bool(sflags & 0x0020) + bool(sflags & 0x0010))
    return struct.Struct(form), tuple(names), None


class Decoder:
    """Walks a recording's bytes; records are recognised by a marker, samples by the flags of the current block."""

    def __init__(self, data: bytes, start_marker: str, end_marker: str):
        at = data.find(END_OF_PREAMBLE)
        if at < 0:
            raise ValueError("no end of the preamble: not an EyeLink recording")
        self.preamble = data[: at + len(END_OF_PREAMBLE)].decode("latin-1")
        self.data, self.pos = data[at + len(END_OF_PREAMBLE) :], 0
        self.markers = start_marker, end_marker
        self.trial, self.inside, self.flags, self.now = 0, False, 0, 0
        self.samples: list[dict] = []
        self.events: list[dict] = []
        self.recordings: list[dict] = []

    def zeros(self) -> None:
        while self.pos < len(self.data) and not self.data[self.pos]:
            self.pos += 1

    def run(self) -> Decoder:
        d = self.data
        while self.pos + 7 <= len(d):
            kind = d[self.pos] & 0x3F
            marked = d[self.pos + 2] == 0x21 or d[self.pos + 2] == 0x41 and kind in CONTROL
            if marked and kind in KNOWN:
                eye, ts = EYES[d[self.pos] >> 6], int.from_bytes(d[self.pos + 3 : self.pos + 7], "big")
                self.pos += 7
                self.record(kind, eye, ts)
            elif not self.sample():
                self.pos += 1
        return self

    def current(self) -> int | None:
        return self.trial if self.inside else None

    def sample(self) -> bool:
        """Reads a sample if the next word is the block's flags, whatever the bit for full times, and bit 0."""
        if not self.flags:
            return False
        d, p = self.data, self.pos
        word = int.from_bytes(d[p : p + 2], "big")
        if (word & ~FULL_TIME) not in ((self.flags & ~FULL_TIME), (self.flags & ~FULL_TIME) | 1):
            return False
        layout, names, _ = sample_layout(self.flags)
        p += 2
        width = 4 if word & FULL_TIME else 1
        if p + width + layout.size > len(d):
            return False
        step = int.from_bytes(d[p : p + width], "big")
        self.now = step if width == 4 else self.now + step
        row = dict(zip(names, layout.unpack_from(d, p + width), strict=True))
        self.pos = p + width + layout.size
        out = {"time": self.now, "trial": self.current(), "flags": word, "input": row.pop("input", 0), "errors": row.pop("status", 0)}
        for n, v in row.items():
            if v != MISSING and not n.startswith("p") or n.startswith("pa") and v != MISSING:
                out[n] = v / 10 if n[0] in "gr" else float(v)
        self.samples.append(out)
        return True

    def record(self, kind: int, eye: int, ts: int) -> None:
        d, e = self.data, {"time": ts, "type": kind, "sttime": ts, "entime": ts, "eye": eye, "message": "", "input": 0, "buttons": 0}
        if kind == S.MESSAGE:
            n = d[self.pos + 2] if self.pos + 2 < len(d) else 0
            e["message"] = d[self.pos + 3 : self.pos + 3 + n].decode("latin-1").replace("\0", "")
            self.pos = min(len(d), self.pos + 3 + n)
            self.zeros()
            if e["message"].startswith(self.markers[0]):
                self.trial, self.inside = self.trial + 1, True
            elif e["message"].startswith(self.markers[1]):
                self.inside = False
        elif kind in (S.INPUT, S.BUTTON):
            e["input" if kind == S.INPUT else "buttons"] = d[self.pos + 2] if self.pos + 2 < len(d) else 0
            self.pos += 4
            self.zeros()
        elif kind in (S.END_SACC, S.END_FIX, S.FIX_UPDATE):
            e |= self.eye_event(kind)
        elif kind in CONTROL:
            self.block(kind, ts)
            return
        elif kind == S.LOST_DATA:
            return
        self.events.append(e)

    def eye_event(self, kind: int) -> dict:
        size, fields = (SACC_SIZE, SACC_FIELDS) if kind == S.END_SACC else (FIX_SIZE, FIX_FIELDS)
        body = self.data[self.pos : self.pos + size].ljust(size, b"\0")
        self.pos += size
        out = {n: struct.unpack_from(">h", body, i)[0] / 10 for n, i in fields.items()}
        out["entime"] = int.from_bytes(body[1:5], "big")
        if kind == S.END_SACC:
            ppd = (out["supd_x"] + out["supd_y"]) / 2
            size_px = ((out["genx"] - out["gstx"]) ** 2 + (out["geny"] - out["gsty"]) ** 2) ** 0.5
            return out | {"ampl": size_px / ppd if ppd > 0 else 0.0, "havx": out["hstx"], "havy": out["hsty"], "gavx": out["gstx"], "gavy": out["gsty"], "eupd_x": out["supd_x"], "eupd_y": out["supd_y"]}
        ava = float(struct.unpack_from(">h", body, FIX_PUPIL)[0])
        same = {"gstx": "gavx", "genx": "gavx", "gsty": "gavy", "geny": "gavy", "henx": "hstx", "havx": "hstx", "heny": "hsty", "havy": "hsty"}
        return out | {a: out[b] for a, b in same.items()} | {"ava": ava, "sta": ava, "ena": ava}

    def block(self, kind: int, ts: int) -> None:
        """A recording block: one byte at its end, 29 at its start (rate, event flags, eye, sample flags)."""
        d = self.data
        if self.pos >= len(d):
            return
        r = {"time": ts, "sample_rate": 0.0, "eflags": 0, "sflags": 0, "state": S.RECORDING_END, "record_type": 3, "pupil_type": 0, "recording_mode": 1, "filter_type": 2, "pos_type": 0, "eye": S.LEFT, "trial": self.current()}
        if d[self.pos] & 1:
            body = d[self.pos : self.pos + 29]
            self.pos += len(body)
            word = lambda i: int.from_bytes(body[i : i + 2], "big") if len(body) >= i + 2 else 0
            r |= {"sample_rate": float(word(1)), "eflags": word(3), "sflags": word(26), "state": S.RECORDING_START, "pupil_type": word(3) & 1}
            left, right = (bool(r["sflags"] & b) for b in BOTH_BITS)
            r["eye"] = S.BINOCULAR if left and right else S.RIGHT if right else S.LEFT if left else {2: S.BINOCULAR, 1: S.RIGHT}.get(body[12] if len(body) > 12 else 0, S.LEFT)
        else:
            self.pos += 1
        self.recordings.append(r)
        if r["sample_rate"] in PLAUSIBLE and r["sflags"] and kind in (S.START_SAMPLES, S.END_SAMPLES):
            self.flags = r["sflags"]


_ZERO = {"samples": {"flags": 0, "input": 0, "errors": 0}, "events": {"read": 0, "status": 0, "flags": 0, "parsedby": 0}, "recordings": {}}


def _frame(rows: list[dict], kind: str, schema, rid: str) -> pd.DataFrame:
    """Rows as a frame with all declared columns."""
    out = pd.DataFrame(rows, columns=[f.name for f in schema.fields if f.name not in ("recording_id", "sample_idx", "event_seq")])
    for c, v in _ZERO[kind].items():
        out[c] = out[c].fillna(v)
    out.insert(0, "recording_id", rid)
    if kind != "recordings":
        out.insert(1, "sample_idx" if kind == "samples" else "event_seq", range(len(out)))
    if "trial" in out:
        out["trial"] = out["trial"].astype("Int64")
    return out


def read_eyelink_binary(spark: SparkSession, paths: str | Sequence[str], start_marker: str = S.TRIAL_START_MARKER, end_marker: str = S.TRIAL_END_MARKER) -> RawRecording:
    """Samples, events and recording blocks of binary recordings."""
    files = contents(spark, paths)

    def table(kind: str, schema) -> DataFrame:
        def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for rid, content in zip(pdf["recording_id"], pdf["content"], strict=True):
                    rows = getattr(Decoder(bytes(content), start_marker, end_marker).run(), kind)
                    for i in range(0, max(len(rows), 1), 100_000):
                        part = _frame(rows[i : i + 100_000], kind, schema, rid)
                        if kind != "recordings":
                            part[part.columns[1]] += i
                        yield part

        return files.mapInPandas(decode, schema)

    return RawRecording(table("samples", S.RAW_SAMPLES), table("events", S.EVENTS), table("recordings", S.RECORDINGS), None, RecordingMeta(source="eyelink"))
