"""Queries over MIDI and sound. Melodies come from whole tables: works as MIDI files, the nations' keys as short rendered tunes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canzona.functions import signal as S
from canzona.plans.figures import D, works
from canzona.plans.integrity import table
from canzona.sources import midi as M

QUERIES: dict = {}
SQL: dict[str, str] = {}
_TUNE = "CAST(n_nationkey AS INT) AS id, transform(sequence(0, 9), i -> 60 + CAST(pmod(n_nationkey * 3 + i * i * 2 + i, 13) AS INT)) AS pitches"


def files(s: SparkSession, d: str) -> DataFrame:
    """path, content: each work as a MIDI file of a named melody over a bass."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = [M.file_bytes([("bass line", [(int(p) - 24, k, k + 1.0) for k, p in enumerate(ps)]), ("melody", [(int(p), k, k + 0.5) for k, p in enumerate(ps)])]) for ps in b["pitches"]]
            yield pd.DataFrame({"path": b["path"], "content": data})

    return works(s, d).select(F.col("doc_id").cast("string").alias("path"), "pitches").mapInPandas(write, "path string, content binary")


def tunes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "nation").selectExpr(*_TUNE.split(", transform")[0:1], "transform" + _TUNE.split(", transform")[1])


def per_tune(s: SparkSession, d: str, made, schema: str) -> DataFrame:
    """The rows made(id, pitches) gives for each tune."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for i, ps in zip(b["id"], b["pitches"]) for r in made(int(i), [int(p) for p in ps])], columns=names)

    return tunes(s, d).repartition(8, "id").mapInPandas(run, schema)


def heard(pitches, **how):
    """The notes tracked in a rendered tune."""
    x = S.melody(pitches, [0.34] * len(pitches), **how)
    return x, S.notes(S.track(x), S.onsets(x))


def _transcribed(i, ps):
    return [(i, k, round(on, 4), round(du, 4), c[0][0], round(c[0][1], 4)) for k, (on, du, c) in enumerate(heard(ps)[1])]


def _analysed(i, ps):
    x, found = heard(ps)
    bpm, beats, sure = S.tempo(x)
    marks = S.stress([n[0] for n in found], beats)
    right = [n[2][0][0] for n in found] == ps
    return [(i, len(found), right, round(float(bpm), 3), round(sure, 4), ",".join(marks))]


CONDITIONS = ((0.0, 0.0), (0.15, 0.0), (0.35, 0.0), (0.35, 45.0), (0.6, 45.0), (0.9, 60.0))


def _degraded(i, ps):
    out = []
    for noise, vibrato in CONDITIONS:
        found = heard(ps, noise=noise, vibrato=vibrato, seed=i)[1]
        got = [n[2][0][0] for n in found]
        rival = sum(any(p == c for c, _ in n[2]) for p, n in zip(ps, found))
        out.append((i, noise, vibrato, float(np.mean([n[2][0][1] for n in found])) if found else 0.0, got == ps, sum(a == b for a, b in zip(ps, got)), rival))
    return out


_KINDS = {
    "dsp_synth": (lambda i, p: [(i, len(S.melody(p)), round(float(np.abs(S.melody(p)).max()), 4))], "id int, samples int, peak double"),
    "dsp_onset_env": (lambda i, p: [(i, len(S.onset_strength(S.melody(p))[0]), round(float(S.onset_strength(S.melody(p))[0].mean()), 6))], "id int, frames int, mean double"),
    "dsp_onsets": (lambda i, p: [(i, k, round(float(t), 4)) for k, t in enumerate(S.onsets(S.melody(p)))], "id int, k int, t double"),
    "dsp_tempo": (lambda i, p: [(i, round(float(S.tempo(S.melody(p))[0]), 4), round(S.tempo(S.melody(p))[2], 4))], "id int, bpm double, confidence double"),
    "dsp_yin": (lambda i, p: [(i, int(v.sum()), round(float(h[v, 0].mean()), 3), round(float(q[v].sum(axis=1).mean()), 6)) for _, h, q, v in [S.track(S.melody(p))]], "id int, voiced int, mean_hz double, mass double"),
    "dsp_notes": (_transcribed, "id int, k int, onset double, duration double, pitch int, confidence double"),
    "win_note_segment": (lambda i, p: [(i, len(heard(p)[1]))], "id int, notes int"),
    "join_onset_frames": (lambda i, p: [(i, int(k)) for x in [S.melody(p)] for k in np.searchsorted(S.track(x)[0], S.onsets(x))], "id int, frame int"),
    "win_peak_pick": (lambda i, p: [(i, len(S.onsets(S.melody(p))))], "id int, peaks int"),
    "dsp_stress": (lambda i, p: [(i, ",".join(S.stress(S.onsets(S.melody(p)), S.tempo(S.melody(p))[1])))], "id int, stress string"),
    "dsp_mixture": (lambda i, p: [(i, len(m), round(float(np.corrcoef(m, v)[0, 1]), 4)) for m, v in [S.mixture(p)]], "id int, samples int, likeness double"),
    "dsp_separate": (lambda i, p: [(i, bool(np.array_equal(S.lead_signal(m)[0], m)), S.lead_signal(m)[1]) for m, _ in [S.mixture(p)]], "id int, same boolean, reason string"),
    "dsp_lead_signal": (lambda i, p: [(i, S.lead_signal(S.melody([x - 24 for x in p]), lambda x: -x)[1])], "id int, reason string"),
    "sink_wav": (lambda i, p: [(i, len(S.wav_bytes(S.melody(p))))], "id int, size int"),
    "src_audio": (lambda i, p: [(i, len(S.read_wav(S.wav_bytes(S.melody(p, rate=11025), 11025))))], "id int, samples int"),
    "pipe_analyse": (_analysed, "id int, notes int, exact boolean, bpm double, confidence double, stress string"),
    "_degraded": (_degraded, "id int, noise double, vibrato double, confidence double, exact boolean, first_right int, among_candidates int"),
}
for _name, (_made, _schema) in _KINDS.items():
    QUERIES[_name] = lambda s, d, m=_made, c=_schema: per_tune(s, d, m, c)
_by_tune = QUERIES.pop("_degraded")
QUERIES["agg_degradation"] = lambda s, d: _by_tune(s, d).groupBy("noise", "vibrato").agg(
    F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("mean_conf"), F.sum(F.col("exact").cast("int")).alias("exact"), F.sum("first_right").alias("first_right"), F.sum("among_candidates").alias("among_candidates"))


def _corpus(s: SparkSession, d: str) -> DataFrame:
    """status and confidence of every tune as a recording."""
    return QUERIES["dsp_notes"](s, d).groupBy("id").agg(F.count("*").alias("notes"), F.avg("confidence").alias("confidence"), F.sort_array(F.collect_list(F.struct("k", "pitch"))).alias("line"))


QUERIES["src_audio_corpus"] = lambda s, d: _corpus(s, d).filter("notes >= 8").select("id", F.array_join(F.transform("line", lambda x: x["pitch"].cast("string")), ",").alias("pitches"))
QUERIES["agg_transcribe_stats"] = lambda s, d: tunes(s, d).select("id").join(_corpus(s, d), "id", "left").agg(
    F.count("*").alias("attempted"), F.count_if(F.col("notes").isNull()).alias("failed"), F.count_if(F.col("notes") < 8).alias("too_short"), F.round(F.avg("confidence"), 4).alias("mean_conf"), F.round(F.median("confidence"), 4).alias("median_conf"))
# what is known of the tunes beforehand: their notes, their samples (0.38 s and a rest of 0.045 s a note) and how they are used
_KNOWN = "WITH t AS (SELECT n_nationkey::INT AS id, list_transform(range(10), lambda i: 60 + (n_nationkey * 3 + i * i * 2 + i) % 13) AS pitches, 10 * (CAST(floor(0.38 * 22050) AS INT) + CAST(floor(0.045 * 22050) AS INT)) AS samples FROM nation)\n"
SQL["src_audio_corpus"] = _KNOWN + "SELECT id, array_to_string(pitches, ',') AS pitches FROM t"
SQL["win_note_segment"] = _KNOWN + "SELECT id, len(pitches)::INT AS notes FROM t"
SQL["dsp_synth"] = _KNOWN + "SELECT id, samples::INT AS samples, 0.92::DOUBLE AS peak FROM t"
SQL["sink_wav"] = _KNOWN + "SELECT id, (44 + 2 * samples)::INT AS size FROM t"
SQL["src_audio"] = _KNOWN + "SELECT id, (2 * 10 * (CAST(floor(0.38 * 11025) AS INT) + CAST(floor(0.045 * 11025) AS INT)))::INT AS samples FROM t"
SQL["dsp_separate"] = _KNOWN + "SELECT id, true AS same, 'no separator installed: the raw mix is used' AS reason FROM t"
SQL["dsp_lead_signal"] = _KNOWN + "SELECT id, CASE WHEN list_median(list_transform(pitches, lambda p: p - 24)) < 55 THEN 'led by its bass' ELSE 'already in a melodic register' END AS reason FROM t"
QUERIES["src_midi_events"] = lambda s, d: M.note_rows(files(s, d)).groupBy("path", "name").agg(F.count("*").alias("notes"), F.sum("pitch").alias("pitch_sum"), F.round(F.max("end"), 6).alias("end"))
SQL["src_midi_events"] = f"""WITH {D}, x AS (SELECT doc_id::VARCHAR AS path, unnest(pitches) AS p, len(pitches) AS n FROM d)
SELECT path, 'melody' AS name, count(*) AS notes, sum(p)::BIGINT AS pitch_sum, (n - 0.5)::DOUBLE AS end FROM x GROUP BY path, n
UNION ALL SELECT path, 'bass line', count(*), sum(p - 24)::BIGINT, n::DOUBLE FROM x GROUP BY path, n""".replace(" AS end", ' AS "end"')
QUERIES["src_midi_dir"] = lambda s, d: M.melody_rows(files(s, d)).select("path", F.array_join(F.col("pitches").cast("array<string>"), ",").alias("pitches"))
SQL["src_midi_dir"] = f"WITH {D} SELECT doc_id::VARCHAR AS path, array_to_string(pitches, ',') AS pitches FROM d WHERE len(pitches) >= 16"
QUERIES["midi_melody"] = lambda s, d: M.melody_rows(files(s, d), 12).select("path", F.size("pitches").alias("notes"))
SQL["midi_melody"] = f"WITH {D} SELECT doc_id::VARCHAR AS path, len(pitches)::INT AS notes FROM d WHERE len(pitches) >= 12"


def _scored(s: SparkSession, d: str) -> DataFrame:
    notes = F.col("notes")
    return M.track_rows(files(s, d)).select("path", "track", "name", M.melodic(notes, F.col("name")).alias("score"), M.polyphony(notes).alias("voices"), F.size(M.top_line(notes)).alias("line"))


QUERIES["agg_track_score"] = lambda s, d: _scored(s, d).filter("score is not null").select("path", "name", F.round("score", 6).alias("score"))
SQL["agg_track_score"] = f"""WITH {D}, x AS (SELECT doc_id::VARCHAR AS path, unnest(pitches) AS p, len(pitches) AS n FROM d WHERE len(pitches) >= 12)
SELECT path, 'melody' AS name, round(40 + 18 - 0.9 * abs(avg(p) - 70) + least(n, 400) / 100.0, 6)::DOUBLE AS score FROM x GROUP BY path, n
UNION ALL SELECT path, 'bass line', round(-40 + 18 - 0.9 * abs(avg(p) - 24 - 70) + least(n, 400) / 100.0, 6)::DOUBLE FROM x GROUP BY path, n"""
SQL["flt_melody_score"] = f"SELECT path, name FROM ({SQL['agg_track_score']}) WHERE score >= 0"
QUERIES["flt_melody_score"] = lambda s, d: _scored(s, d).filter("score >= 0").select("path", "name")
# notes of one track never overlap here, so each sounds alone and the line is the track
_TRACKS = f"WITH {D} SELECT doc_id::VARCHAR AS path, k::INT AS track, {{0}} FROM d, (VALUES (0), (1)) AS t(k)"
SQL["agg_polyphony"] = _TRACKS.format("CASE WHEN len(pitches) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS voices")
SQL["win_skyline"] = _TRACKS.format("len(pitches)::INT AS line")
QUERIES["agg_polyphony"] = lambda s, d: _scored(s, d).select("path", "track", "voices")
QUERIES["win_skyline"] = lambda s, d: _scored(s, d).select("path", "track", "line")
