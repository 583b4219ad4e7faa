"""Row types of the input tables and of the event stream."""

from __future__ import annotations

META = (
    "struct<target:string,text:string,point:string,snapshot:array<string>,duration:string,"
    "profit:string,kills_official:string,container:string,prev:int,cur:int,"
    "context:array<string>,voice_hint:array<string>,hero:string,weapons:array<string>,"
    "operator:string,operator_class:string,primary_weapon:string,primary_weapon_type:string,"
    "weapon_source:string,weapon_reads:array<struct<name:string,type:string,reads:int>>,"
    "operator_reads:map<string,int>>"
)
EVENTS = (
    "session string, src string, part_dir string, kind string, t_start double, t_end double, "
    f"detail string, confidence double, price bigint, price_source string, meta {META}"
)
PARTS = "session string, src string, filename string, part_seq int, duration_s double"
READINGS = (
    "session string, src string, t double, seq int, text string, score double, cx double, "
    "cy double, box_w double, box_h double, frame_w int, frame_h int"
)
SENTENCES = (
    "session string, src string, id int, start double, end double, text string, speaker string"
)
EMBEDDINGS = "session string, src string, id int, embedding array<float>"
AUDIO_BINS = "session string, src string, bin int, rms double, f0 double"
FRAME_DIFFS = "src string, t double, diff double"
FILES = "root string, path string, size bigint, mtime double, is_video boolean"
JOBS = (
    "key string, path string, session string, state string, attempts int, enqueued_at string, "
    "updated_at string, note string, done_key string"
)
LABELS = "session string, file string, picked boolean, verdict string, score_override double"
PIPELINE_LOG = "session string, ts timestamp, line string"
GROWTH = "src string, ts timestamp, size bigint"
PRESENCE = "host string, ts timestamp, process_name string"
TRANSCRIPT = (
    "game string, model string, duration_s double, "
    "sentences array<struct<id:int,start:double,end:double,text:string,speaker:string>>"
)
MANIFEST = (
    "contract_version string, session string, mode string, pushed_at string, "
    "parts array<struct<client_video:string,filename:string,asr_dir:string,events_rpt:string,"
    "voice_dir:string>>, missing array<string>, "
    "lines struct<knockdowns:string,pickups:string,voice:array<string>,report:string>, "
    "logs array<string>"
)
