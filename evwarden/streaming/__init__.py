from evwarden.streaming.check import check_stream, check_streams, match_stream, use_rocksdb
from evwarden.streaming.windows import latest_watermark, sources_together, use_latest_watermark, windowed_counts

__all__ = [
    "check_stream", "check_streams", "latest_watermark", "match_stream", "sources_together", "use_latest_watermark", "use_rocksdb", "windowed_counts",
]
