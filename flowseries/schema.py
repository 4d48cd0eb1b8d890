"""Record kinds of a trace, their byte layouts and series, and the columns of points and of the store."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import types as T

INT, FLOAT, BOOLEAN, STRING = 0, 1, 2, 3
TYPE_NAMES = ("Int", "Float", "Boolean", "String")
VALUE_COLUMNS = ("value_int", "value_float", "value_bool", "value_text")
L4PROTO_TCP = 6
AF_INET = 2
MARKER = b"\xff\xff\xff\xff"


@dataclass(frozen=True)
class Kind:
    """A record layout (little-endian, packed, marker last), the fields that become series, and the series' names."""

    name: str
    fields: tuple[tuple[str, str], ...]
    series: tuple[tuple[str, str], ...] = ()

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([*self.fields, ("marker", "V4")])

    @property
    def size(self) -> int:
        return self.dtype.itemsize

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, _spark(k, n)) for n, k in self.fields])


_FLAGS = ("urg", "ack", "psh", "rst", "syn", "fin")


def _spark(kind: str, name: str) -> T.DataType:
    if kind[0] == "V":
        return T.BinaryType()
    return T.BooleanType() if kind == "?" else T.LongType()


# Byte layouts of the trace files, and the names of their series.
PACKET = Kind(
    "packet",
    (
        ("time", "<u8"), ("saddr", "<u4"), ("daddr", "<u4"), ("saddr_v6", "V16"), ("daddr_v6", "V16"), ("sport", "<u2"), ("dport", "<u2"),
        ("seq", "<u4"), ("ack_num", "<u4"), ("window", "<u2"), *((f, "?") for f in _FLAGS), ("checksum", "<u2"),
    ),
    (
        ("seq", "SEQ_NUM"), ("ack_num", "ACK_NUM"), ("window", "WINDOW"), ("urg", "FLAG_URG"), ("ack", "FLAG_ACK"), ("psh", "FLAG_PSH"),
        ("rst", "FLAG_RST"), ("syn", "FLAG_SYN"), ("fin", "FLAG_FIN"), ("checksum", "CHECKSUM"),
    ),
)
PROBE = Kind(
    "probe",
    (
        ("time", "<u8"), ("saddr", "V28"), ("daddr", "V28"), ("sport", "<u2"), ("dport", "<u2"), ("family", "<u2"), ("mark", "<u4"), ("data_len", "<u2"),
        ("snd_nxt", "<u4"), ("snd_una", "<u4"), ("snd_cwnd", "<u4"), ("ssthresh", "<u4"), ("snd_wnd", "<u4"), ("srtt", "<u4"), ("rcv_wnd", "<u4"), ("sock_cookie", "<u8"),
    ),
    (
        ("mark", "MARK"), ("data_len", "DATA_LEN"), ("snd_nxt", "SND_NXT"), ("snd_una", "SND_UNA"), ("snd_cwnd", "SND_CWND"), ("ssthresh", "SSTRESH"),
        ("snd_wnd", "SND_WND"), ("srtt", "SRTT"), ("rcv_wnd", "RCV_WND"), ("sock_cookie", "SOCK_COOKIE"),
    ),
)
_SOCK_SERIES = (
    ("pacing_rate", "<u8"), ("max_pacing_rate", "<u8"), ("backoff", "u1"), ("rto", "<u4"), ("ato", "<u4"), ("rcv_mss", "<u2"), ("snd_cwnd", "<u4"),
    ("bytes_acked", "<u8"), ("snd_ssthresh", "<u4"), ("total_retrans", "<u4"), ("probes", "u1"), ("lost", "<u4"), ("sacked_out", "<u4"), ("retrans", "<u4"),
    ("rcv_ssthresh", "<u4"), ("rttvar", "<u4"), ("advmss", "<u2"), ("reordering", "<u4"), ("rcv_rtt", "<u4"), ("rcv_space", "<u4"),
    ("bytes_received", "<u8"), ("segs_out", "<u4"), ("segs_in", "<u4"), ("snd_wscale", "<u2"), ("rcv_wscale", "<u2"),
)
_PAIR = (("time", "<u8"), ("addr_v4", "<u8"), ("src_v6", "V16"), ("dst_v6", "V16"), ("ports", "<u4"), ("family", "<u2"))
SOCK = Kind("sock", (*_PAIR, *_SOCK_SERIES), tuple((n, n) for n, _ in _SOCK_SERIES))
CWND = Kind("cwnd", (*_PAIR, ("snd_cwnd", "<u4")), (("snd_cwnd", "perf_snd_cwnd"),))
RETRANSMIT_SYNACK = Kind(
    "retransmit_synack",
    (("time", "<u8"), ("sport", "<u2"), ("dport", "<u2"), ("family", "<u2"), ("saddr", "V4"), ("daddr", "V4"), ("saddr_v6", "V16"), ("daddr_v6", "V16")),
)
BAD_CSUM = Kind("bad_csum", (("time", "<u8"), ("saddr", "V4"), ("daddr", "V4")))

KINDS = {k.name: k for k in (PACKET, PROBE, SOCK, CWND, RETRANSMIT_SYNACK, BAD_CSUM)}
#: File name without extension: kind and direction.
FILES = {
    "xdp": ("packet", "ingress"), "tc": ("packet", "egress"), "probe": ("probe", None), "send_sock": ("sock", "send"), "recv_sock": ("sock", "recv"),
    "send_cwnd": ("cwnd", "send"), "recv_cwnd": ("cwnd", "recv"), "retransmit_synack": ("retransmit_synack", None), "bad_csum": ("bad_csum", None),
}

POINTS = "flow_id long, series_id long, name string, type int, ts double, ts_ns long, value_int long, value_float double, value_bool boolean, value_text string"
STORE = {
    "flows": "id long, src string, dst string, sport int, dport int, l4proto int",
    "flow_attributes": "id long, flow_id long, name string, type int, value_int long, value_float double, value_bool boolean, value_text string",
    "time_series": "time_series_id long, flow_id long, name string, type int",
    "time_series_data": "time_series_id long, ts double, ts_ns long, type int, value_int long, value_float double, value_bool boolean, value_text string",
    "quarantine": "part string, reason string, flow_id long, time_series_id long, name string, type int, ts double, ts_ns long, value_int long, value_float double, value_bool boolean, value_text string, record string",
    "accounts": "part string, kind string, records long, corrupt long, points long, stored long, known long, quarantined long",
}
