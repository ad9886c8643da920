"""Dimensions and colour of images from their headers; audio and video through ffprobe where it is installed."""

from __future__ import annotations

import json
import math
import re
import shutil
import struct
import subprocess
import xml.etree.ElementTree as ET

_PNG = {0: "grayscale", 2: "rgb", 3: "palette", 4: "grayscale+alpha", 6: "rgba"}


def _png(d: bytes) -> dict:
    w, h, depth, colour = struct.unpack(">IIBB", d[16:26])
    return {"format": "png", "width": w, "height": h, "bit_depth": depth, "color_type": _PNG.get(colour)}


def jpeg_frame(d: bytes) -> dict:
    """Size, precision and subsampling from the frame header; fill bytes and other segments are walked over."""
    p = 2
    while p + 4 <= len(d):
        if d[p] != 0xFF:
            raise ValueError("bad JPEG marker")
        while p < len(d) - 1 and d[p + 1] == 0xFF:
            p += 1
        m = d[p + 1]
        if m in (0x01, *range(0xD0, 0xD9)):
            p += 2
            continue
        n = struct.unpack(">H", d[p + 2 : p + 4])[0]
        if 0xC0 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC):
            depth, h, w, parts = struct.unpack(">BHHB", d[p + 4 : p + 10])
            sub = [(d[p + 11 + 3 * k] >> 4, d[p + 11 + 3 * k] & 15) for k in range(parts)]
            kind = None
            if parts == 1:
                kind = "grayscale"
            elif parts >= 3 and sub[1] == sub[2] and all(sub[1]):
                kind = {(1, 1): "4:4:4", (2, 1): "4:2:2", (2, 2): "4:2:0", (4, 1): "4:1:1", (1, 2): "4:4:0"}.get((sub[0][0] // sub[1][0], sub[0][1] // sub[1][1]))
            return {"format": "jpeg", "width": w, "height": h, "bit_depth": depth, "chroma_subsampling": kind, "compression": "progressive" if m == 0xC2 else "baseline", "color_type": "grayscale" if parts == 1 else "ycbcr"}
        p += 2 + n
    raise ValueError("no JPEG frame")


def _tiff(d: bytes) -> dict:
    e = "<" if d[:2] == b"II" else ">"
    at = struct.unpack(e + "I", d[4:8])[0]
    out: dict = {"format": "tiff"}
    n = min(20, struct.unpack(e + "H", d[at : at + 2])[0])
    for k in range(n):
        tag, kind, count = struct.unpack(e + "HHI", d[at + 2 + 12 * k : at + 10 + 12 * k])
        raw = d[at + 10 + 12 * k : at + 14 + 12 * k]
        if kind == 3 and count > 2:
            place = struct.unpack(e + "I", raw)[0]
            raw = d[place : place + 2]
        v = struct.unpack(e + "H", raw[:2])[0] if kind == 3 else struct.unpack(e + "I", raw)[0]
        if tag in (256, 257, 258, 262):
            out[{256: "width", 257: "height", 258: "bit_depth", 262: "color_type"}[tag]] = v
    if "color_type" in out:
        out["color_type"] = {0: "grayscale", 1: "grayscale", 2: "rgb", 3: "palette", 4: "mask", 5: "cmyk", 6: "ycbcr", 8: "cielab"}.get(out["color_type"])
    return out


def _svg(d: bytes) -> dict:
    root = ET.fromstring(d)
    px = lambda v: float(m[1]) if (m := re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*(?:px)?\s*", v or "")) and float(m[1]) > 0 else None
    w, h = px(root.get("width")), px(root.get("height"))
    box = [float(x) for x in re.split(r"[\s,]+", root.get("viewBox", "").strip()) if x]
    if (w is None or h is None) and len(box) == 4:
        w, h = box[2], box[3]
    return {"format": "svg"} | ({"width": int(w), "height": int(h)} if w and h else {})


def image_summary(d: bytes) -> dict:
    if d[:8] == b"\x89PNG\r\n\x1a\n":
        out = _png(d)
    elif d[:2] == b"\xff\xd8":
        out = jpeg_frame(d)
    elif d[:6] in (b"GIF87a", b"GIF89a"):
        w, h, flags = struct.unpack("<HHB", d[6:11])
        out = {"format": "gif", "width": w, "height": h, "bit_depth": ((flags >> 4) & 7) + 1, "color_type": "palette"}
    elif d[:2] == b"BM":
        w, h, _, bits, packed = struct.unpack("<iiHHI", d[18:34])
        out = {"format": "bmp", "width": w, "height": abs(h), "bit_depth": bits, "compression": {0: "none", 1: "rle8", 2: "rle4", 3: "bitfields"}.get(packed), "color_type": "rgba" if bits == 32 else "rgb" if bits >= 16 else "palette"}
    elif d[:4] in (b"II*\0", b"MM\0*"):
        out = _tiff(d)
    elif d[:4] == b"RIFF" and d[8:12] == b"WEBP":
        kind = d[12:16]
        if kind == b"VP8 ":
            w, h = (x & 0x3FFF for x in struct.unpack("<HH", d[26:30]))
        elif kind == b"VP8L":
            v = struct.unpack("<I", d[21:25])[0]
            w, h = (v & 0x3FFF) + 1, ((v >> 14) & 0x3FFF) + 1
        else:
            w, h = int.from_bytes(d[24:27], "little") + 1, int.from_bytes(d[27:30], "little") + 1
        out = {"format": "webp", "width": w, "height": h, "compression": {b"VP8 ": "lossy", b"VP8L": "lossless"}.get(kind, "extended")}
    elif d[:4] == b"\0\0\1\0":
        out = {"format": "ico", "width": d[6] or 256, "height": d[7] or 256, "bit_depth": struct.unpack("<H", d[12:14])[0]}
    elif b"<svg" in d[:4096]:
        out = _svg(d)
    else:
        raise ValueError("unknown image format")
    if out.get("width") and out.get("height"):
        g = math.gcd(out["width"], out["height"])
        out["aspect_ratio"] = f"{out['width'] // g}:{out['height'] // g}"
    return out | {"stream_size": len(d)}


def probe_summary(d: bytes) -> dict:
    """Format and streams as ffprobe tells them; the size alone where it isn't installed."""
    tool = shutil.which("ffprobe")
    if not tool:
        return {"stream_size": len(d), "note": "ffprobe isn't installed"}
    told = json.loads(subprocess.run([tool, "-v", "quiet", "-of", "json", "-show_format", "-show_streams", "-i", "pipe:0"], input=d, capture_output=True, check=True, timeout=60).stdout)
    streams = told.get("streams", [])
    first = lambda kind: next((s for s in streams if s.get("codec_type") == kind), {})
    v, a = first("video"), first("audio")
    rate = v.get("avg_frame_rate", "0/0").split("/")
    return {
        "duration": told.get("format", {}).get("duration"), "bit_rate": told.get("format", {}).get("bit_rate"), "container": told.get("format", {}).get("format_name"),
        "video_codec": v.get("codec_name"), "width": v.get("width"), "height": v.get("height"), "pixel_format": v.get("pix_fmt"),
        "frame_rate": float(rate[0]) / float(rate[1]) if len(rate) == 2 and rate[1] not in ("0", "") else None,
        "audio_codec": a.get("codec_name"), "channels": a.get("channels"), "sample_rate": a.get("sample_rate"), "tags": told.get("format", {}).get("tags"), "stream_size": len(d),
    }
