"""Queries over recordings as frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from callwatch.operators import audio
from callwatch.plans import views
from callwatch.plans.sql import with_views
from callwatch.runtime import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# Parameters of the frame view: 30 ms frames, 90 ms of silence, 60 ms of speech.
S, M = 3, 2
_RANK = "list_sort(l)[cast(round_even((len(l) - 1) * {0} / 100.0, 0) as int) + 1]"
_THRESHOLD = f"""levels as (select audio_id, list(rms) filter (where rms > 0) l from frames group by 1),
 ranks as (select audio_id, l, {_RANK.format(20)} lo, {_RANK.format(90)} hi from levels),
 thr as (select audio_id, case when l is null or len(l) = 0 or hi <= lo then 1000.0 else greatest(1000.0, lo + (hi - lo) * 0.35) end::double threshold from ranks)"""
_SEGMENTS = f"""{_THRESHOLD}, last_frame as (select audio_id, max(frame_idx) z from frames group by 1),
 voiced as (select f.audio_id, frame_idx, frame_idx - lag(frame_idx) over (partition by f.audio_id order by frame_idx) gap from frames f join thr t on f.audio_id = t.audio_id where rms >= threshold),
 runs as (select audio_id, frame_idx, sum(case when gap is null or gap > {S} then 1 else 0 end) over (partition by audio_id order by frame_idx) run from voiced),
 spans as (select r.audio_id, min(frame_idx) a, max(frame_idx) b, any_value(z) z from runs r join last_frame l on r.audio_id = l.audio_id group by r.audio_id, run),
 stops as (select audio_id, a, case when z - b < {S} then z + 1 else b + 2 end e from spans),
 segments as (select audio_id, a * 30 start_ms, e * 30 end_ms from stops where e - a >= {M})"""
FR = with_views("frames", extra=_SEGMENTS)


def _segments(spark, sf_dir, **options):
    f = views.frames(spark, sf_dir)
    return audio.energy_segments(f, audio.adaptive_threshold(f, 1000), **options)


def _recordings(spark, sf_dir):
    return views.frames(spark, sf_dir).groupBy("audio_id").agg((F.count("*") * 30).alias("total_ms"))


@query(FR + "select audio_id, threshold from thr")
def adaptive_threshold(spark, sf_dir):
    return audio.adaptive_threshold(views.frames(spark, sf_dir), 1000)


@query(FR + "select audio_id, start_ms, end_ms from segments")
def vad_segments(spark, sf_dir):
    return _segments(spark, sf_dir)


@query(with_views("frames", extra=f"""{_THRESHOLD}, marked as (select f.audio_id, frame_idx i, rms >= threshold v from frames f join thr t on f.audio_id = t.audio_id),
 walk(audio_id, i, first, last, cut_a, cut_b) as (
  select audio_id, -1::bigint, null::bigint, null::bigint, null::bigint, null::bigint from thr
  union all
  select w.audio_id, m.i,
   case when coalesce(w.first, case when m.v then m.i end) is null then null when not m.v and m.i - w.last >= {S} then null when m.i - coalesce(w.first, m.i) + 1 >= 10 then null else coalesce(w.first, m.i) end,
   case when coalesce(w.first, case when m.v then m.i end) is null then null when not m.v and m.i - w.last >= {S} then null when m.i - coalesce(w.first, m.i) + 1 >= 10 then null when m.v then m.i else w.last end,
   case when w.first is null and not m.v then null when not m.v and m.i - w.last >= {S} then w.first when m.i - coalesce(w.first, m.i) + 1 >= 10 then coalesce(w.first, m.i) end,
   case when w.first is null and not m.v then null when not m.v and m.i - w.last >= {S} then w.last + 2 when m.i - coalesce(w.first, m.i) + 1 >= 10 then m.i + 1 end
  from walk w join marked m on m.audio_id = w.audio_id and m.i = w.i + 1),
 tails as (select audio_id, (list(first order by i))[-1] cut_a, max(i) + 1 cut_b from walk group by 1),
 every as (select audio_id, cut_a, cut_b from walk where cut_a is not null union all select audio_id, cut_a, cut_b from tails where cut_a is not null)""")
    + f"select audio_id, cut_a * 30 as start_ms, cut_b * 30 as end_ms from every where cut_b - cut_a >= {M}")
def vad_segments_max(spark, sf_dir):
    return _segments(spark, sf_dir, max_segment_ms=300)


@query("select e.vec_id as audio_id, (i - 1) // 8 as frame_idx, cast(floor(sqrt(avg(x * x))) as int) as rms from (select vec_id, unnest(generate_series(1, len(embedding))) i, unnest(list_transform(embedding, lambda v: floor(v::double * 1000))) x from embeddings) e group by 1, 2")
def frame_rms(spark, sf_dir):
    samples = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("audio_id"), F.posexplode("embedding").alias("i", "v"))
    return audio.frame_rms(samples.select("audio_id", "i", F.floor(F.col("v").cast("double") * 1000).cast("double").alias("x")), 8)


_REC = ", rec as (select audio_id, count(*) * 30 total_ms from frames group by 1)"


@query(FR + _REC + ", few as (select distinct audio_id from segments where start_ms = 0), left_ as (select r.* from rec r where not exists (select 1 from few where few.audio_id = r.audio_id)) select audio_id, s as start_ms, least(s + 500, total_ms) as end_ms from (select audio_id, total_ms, unnest(generate_series(0, total_ms - 1, 500)) s from left_)")
def fixed_split(spark, sf_dir):
    return audio.fixed_split(_recordings(spark, sf_dir), _segments(spark, sf_dir).filter("start_ms = 0"), 500)


@query(FR + "select audio_id, start_ms, end_ms, concat(audio_id, '_seg_', lpad(cast(row_number() over (partition by audio_id order by start_ms, end_ms) as varchar), 4, '0')) as segment_id, greatest(0, end_ms - start_ms) as duration_ms from segments")
def number_segments(spark, sf_dir):
    return audio.number_segments(_segments(spark, sf_dir))


@query(FR + ", n as (select *, concat(audio_id, '_seg_', lpad(cast(row_number() over (partition by audio_id order by start_ms, end_ms) as varchar), 4, '0')) segment_id from segments) select segment_id, count(*) as frames, avg(rms) as level from n join frames f on f.audio_id = n.audio_id and frame_idx * 30 >= start_ms and frame_idx * 30 < end_ms group by 1")
def slice_frames(spark, sf_dir):
    return audio.slice_frames(views.frames(spark, sf_dir), audio.number_segments(_segments(spark, sf_dir)), 30)


@query(with_views("frames") + _REC + "select audio_id, s as start_ms, least(s + 600, total_ms) as end_ms, s + 600 >= total_ms as is_final from (select audio_id, total_ms, unnest(generate_series(0, greatest(total_ms - 1, 0), 600)) s from rec)")
def stream_chunks(spark, sf_dir):
    return audio.stream_chunks(_recordings(spark, sf_dir), 10)


@query("select path, mtime from (select concat('raw/', event_id) path, event_id % 100 mtime from events) s where not exists (select 1 from (select concat('raw/', event_id) path, event_id % 90 mtime, event_id % 7 <> 0 valid from events where event_id % 3 <> 0) d where d.path = s.path and d.valid and d.mtime >= s.mtime)")
def pending_recordings(spark, sf_dir):
    e, path = table(spark, sf_dir, "events"), F.concat(F.lit("raw/"), F.col("event_id").cast("string"))
    done = e.filter(F.col("event_id") % 3 != 0).select(path.alias("path"), (F.col("event_id") % 90).alias("mtime"), (F.col("event_id") % 7 != 0).alias("valid"))
    return audio.pending_recordings(e.select(path.alias("path"), (F.col("event_id") % 100).alias("mtime")), done)


@query(with_views("calls") + ", o as (select session_id, seq, text from calls where event_id % 5 <> 0), d as (select session_id, seq, concat(text, '*') text from calls where event_id % 7 <> 0) select coalesce(o.session_id, d.session_id) as session_id, coalesce(o.seq, d.seq) as seq, o.text as original_text, d.text as denoised_text from o full join d on o.session_id = d.session_id and o.seq = d.seq")
def variant_compare(spark, sf_dir):
    c = views.calls(spark, sf_dir)
    return audio.variant_compare(c.filter(F.col("event_id") % 5 != 0), c.filter(F.col("event_id") % 7 != 0).withColumn("text", F.concat("text", F.lit("*"))))


@query(FR + ", g as (select *, case when start_ms - max(end_ms) over (partition by audio_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding) > 60 then 1 else 0 end n from segments), h as (select *, sum(n) over (partition by audio_id order by start_ms, end_ms) k from g) select audio_id, min(start_ms) as start_ms, max(end_ms) as end_ms from h group by audio_id, k")
def merge_segments(spark, sf_dir):
    return audio.merge_close_segments(_segments(spark, sf_dir), 60)
