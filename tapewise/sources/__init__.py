"""Sources and sinks."""

from .batches import batch_numbers, micro_batches
from .files import files_state, measure_write, read_features, read_file, scan_features, scan_hour, shared_folder, write_features
from .live import Replay, socket_trades
from .trades import read_trades, stream_dead_letters, stream_trades, synthetic_stream, synthetic_trades, trades_from_rows, validated

__all__ = ["Replay", "batch_numbers", "files_state", "measure_write", "micro_batches", "read_features", "read_file", "read_trades", "scan_features", "scan_hour", "shared_folder", "socket_trades", "stream_dead_letters", "stream_trades", "synthetic_stream", "synthetic_trades", "trades_from_rows", "validated", "write_features"]
