"""Schemas of the catalogue's tables."""

OBJECTS = "ext_id long, seq long, group_id int, digest long, grains int, otype smallint, payload binary"
INDEX = "ext_id long, digest long, grains long, otype smallint, addr long"
SEGMENT_LOG = "ext_id long, seg long, cur long, history_idx long, seq long, digest long, grains long, otype smallint, cycle long, payload binary"
SEGMENTS = "ext_id long, seg long, state string, sealed_hours long, removed long, cycle long, history_idx long"
DELETE_LOG = "ext_id long, ts long, kind string, digests array<long>"
SNAPSHOT = "ext_id long, snap_ts long, hlc_ts long, history_idx long, cur long, gc_src long, gc_dst long, gc_src_cur long, gc_dst_cur long, clone_done long, obj_cnt long, blocks long"
CLONE_JOB = "struct<id:long,parent_id:long,is_source:boolean,state:string,total:long,done:long,oids_oid:decimal(20,0)>"
EXTENTS = f"ext_id long, version smallint, state string, size long, avail long, disk_id string, created int, seg long, cur long, history_next long, snap_idx long, clone_job {CLONE_JOB}"
DISKS = "disk_id string, state string, size long, used long"
PERF = "op string, thread int, t_ns long, latency_ns long, ok boolean"
