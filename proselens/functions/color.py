"""Colours: parsing of CSS values and conversion to hue, saturation and lightness."""

from __future__ import annotations

import colorsys
import math
import re

NAMED = {"purple": (128, 0, 128), "violet": (238, 130, 238), "indigo": (75, 0, 130), "blue": (0, 0, 255), "rebeccapurple": (102, 51, 153), "blueviolet": (138, 43, 226), "mediumpurple": (147, 112, 219), "slateblue": (106, 90, 205), "darkviolet": (148, 0, 211), "darkorchid": (153, 50, 204), "white": (255, 255, 255), "black": (0, 0, 0), "red": (255, 0, 0), "green": (0, 128, 0), "transparent": (0, 0, 0)}
FIND = re.compile(r"#[0-9a-fA-F]{3,8}\b|\b(?:rgba?|hsla?|oklch|oklab)\([^()]*\)|\b(?:" + "|".join(NAMED) + r")\b", re.I)


def _number(text: str, whole: float = 1.0) -> float:
    return float(text[:-1]) / 100 * whole if text.endswith("%") else float(text)


def _hue(text: str) -> float:
    for unit, scale in (("grad", 0.9), ("turn", 360.0), ("rad", 180 / math.pi), ("deg", 1.0)):
        if text.endswith(unit):
            return float(text[: -len(unit)]) * scale
    return float(text)


def parse(text: str) -> tuple[float, float, float, float] | None:
    """(red, green, blue, alpha), each from 0 to 1; None where `text` isn't a colour."""
    t = text.strip().lower()
    try:
        if t.startswith("#"):
            h = t[1:]
            if len(h) in (3, 4):
                h = "".join(c * 2 for c in h)
            if len(h) not in (6, 8):
                return None
            v = [int(h[i : i + 2], 16) / 255 for i in range(0, len(h), 2)]
            return (v[0], v[1], v[2], v[3] if len(v) > 3 else 1.0)
        if t in NAMED:
            return (*(c / 255 for c in NAMED[t]), 0.0 if t == "transparent" else 1.0)
        m = re.fullmatch(r"(rgba?|hsla?|oklch|oklab)\(([^()]*)\)", t)
        if not m:
            return None
        parts = [p for p in re.split(r"[\s,/]+", m[2].strip()) if p]
        if len(parts) not in (3, 4):
            return None
        alpha = min(1.0, max(0.0, _number(parts[3]))) if len(parts) == 4 else 1.0
        if m[1].startswith("rgb"):
            r, g, b = (min(1.0, max(0.0, _number(p, 255.0) / 255)) for p in parts[:3])
        elif m[1].startswith("hsl"):
            r, g, b = colorsys.hls_to_rgb(_hue(parts[0]) % 360 / 360, _number(parts[2]) if "%" in parts[2] else float(parts[2]) / 100, _number(parts[1]) if "%" in parts[1] else float(parts[1]) / 100)
        else:
            light = _number(parts[0])
            if m[1] == "oklch":
                chroma, h = _number(parts[1], 0.4), math.radians(_hue(parts[2]))
                a_, b_ = chroma * math.cos(h), chroma * math.sin(h)
            else:
                a_, b_ = _number(parts[1], 0.4), _number(parts[2], 0.4)
            x, y, z = ((light + k * a_ + j * b_) ** 3 for k, j in ((0.3963377774, 0.2158037573), (-0.1055613458, -0.0638541728), (-0.0894841775, -1.2914855480)))
            linear = (4.0767416621 * x - 3.3077115913 * y + 0.2309699292 * z, -1.2684380046 * x + 2.6097574011 * y - 0.3413193965 * z, -0.0041960863 * x - 0.7034186147 * y + 1.7076147010 * z)
            r, g, b = (min(1.0, max(0.0, 12.92 * c if c <= 0.0031308 else 1.055 * max(c, 0.0) ** (1 / 2.4) - 0.055)) for c in linear)
        return (r, g, b, alpha)
    except ValueError:
        return None


def hsl(rgba: tuple[float, float, float, float]) -> tuple[float, float, float]:
    """Hue in degrees, saturation, lightness."""
    h, light, s = colorsys.rgb_to_hls(*rgba[:3])
    return h * 360, s, light


def triplet(text: str) -> tuple[float, float, float] | None:
    """A bare `H S% L%`."""
    m = re.fullmatch(r"\s*([\d.]+)(?:deg)?\s+([\d.]+)%\s+([\d.]+)%\s*", text)
    return (float(m[1]), float(m[2]) / 100, float(m[3]) / 100) if m else None
