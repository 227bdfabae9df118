"""Times and file names for people."""

from __future__ import annotations

import re
from datetime import datetime


def human_time(seconds: float) -> str:
    """12ms, 3.4s or 2m 3.4s."""
    if seconds < 1:
        return f"{seconds * 1000:.0f}ms"
    whole, rest = int(seconds // 60), seconds % 60
    return f"{whole}m {rest:.1f}s" if whole else f"{rest:.1f}s"


def safe_name(text: str, most: int = 100) -> str:
    """A file name for any text: what file systems or shells may not take becomes an underscore."""
    return re.sub(r'[<>:"/\\|?*\x00-\x1f]', "_", text)[:most] or "_"


def report_folder(platform: str, now: datetime | None = None) -> str:
    """<time>_<platform>, by the second."""
    return f"{(now or datetime.now()):%Y-%m-%d_%H-%M-%S}_{safe_name(platform)}"
