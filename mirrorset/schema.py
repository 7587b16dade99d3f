"""Fixed schemas and the bit values stored in catalogs and results."""

from __future__ import annotations

# --- fixed values: stored flag bits and pixel limits -------------------------------------
FILE_FLAGS = {
    "is_image": 1,
    "manually_excluded": 2,
    "thumbnail_error": 4,
    "metadata_error": 8,
    "too_dark": 16,
    "no_audio_track": 32,
    "audio_fingerprint_error": 64,
    "silent_audio_track": 128,
    "reparse_point": 256,
    "reparse_point_checked": 512,
}
MATCH_FLAGS = {
    "flipped": 1,
    "partial_clip": 2,
    "ai_matched": 4,
    "grayscale_matched": 8,
    "phash_matched": 16,
}
EDITOR_FLAGS = (
    "manually_excluded",
    "thumbnail_error",
    "metadata_error",
    "too_dark",
    "no_audio_track",
    "silent_audio_track",
    "reparse_point",
    "is_image",
)
FRAME_SIDE = 32
BLACK_LIMIT = 0x20
WHITE_LIMIT = 0xF0
BRIGHTNESS_SCALE = 256
VIDEO_EXTENSIONS = (
    "mp4", "wmv", "avi", "mkv", "flv", "mov", "mpg", "mpeg", "m4v", "asf",
    "f4v", "webm", "divx", "m2t", "m2ts", "mts", "vob", "ts", "rmvb", "rm",
)
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "bmp", "tiff", "webp", "heic", "heif")
# -----------------------------------------------------------------------------------------

F_ = FILE_FLAGS
COMPARE_ERRORS = F_["thumbnail_error"] | F_["metadata_error"] | F_["too_dark"]
EDITOR_ERRORS = COMPARE_ERRORS | F_["audio_fingerprint_error"]
CONTENT_FLAGS = (
    F_["thumbnail_error"]
    | F_["metadata_error"]
    | F_["too_dark"]
    | F_["no_audio_track"]
    | F_["audio_fingerprint_error"]
    | F_["silent_audio_track"]
)

STREAM = (
    "struct<index:int,codec_name:string,codec_type:string,width:int,height:int,sample_rate:int,"
    "channel_layout:string,bit_rate:bigint,frame_rate:float,channels:int,hdr_format:string>"
)
CATALOG = (
    "file_id bigint, path string, folder string, is_image boolean, size bigint, "
    "created timestamp_ntz, modified timestamp_ntz, flags int, os_hash string, dev bigint, "
    f"inode bigint, duration_s double, streams array<{STREAM}>"
)
FRAMES = "file_id bigint, pos_idx int, pos_s double, gray array<smallint>, phash bigint"
ITEM = (
    "group_id bigint, path string, folder string, size bigint, duration_s double, "
    "frame_size string, frame_size_int int, format string, audio_format string, "
    "fps double, bitrate_kbs bigint, similarity double, created timestamp_ntz, "
    "is_image boolean, flags int, offset_s double, is_reference boolean, "
    "is_best_bitrate boolean, is_best_frame boolean"
)
