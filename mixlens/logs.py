"""Loggers to the console and to a file of the run."""

from __future__ import annotations

import logging
import sys
from datetime import datetime
from pathlib import Path

FORMAT = "%(asctime)s %(name)s %(levelname)s %(message)s"


def setup_logger(name: str = "mixlens", level: int | str = logging.INFO, folder: str | None = None) -> logging.Logger:
    """The logger of that name with a console handler and, with a folder, a file named by the time. A second call adds none."""
    logger = logging.getLogger(name)
    logger.setLevel(level)
    if not logger.handlers:
        handlers: list[logging.Handler] = [logging.StreamHandler(sys.stdout)]
        if folder:
            Path(folder).mkdir(parents=True, exist_ok=True)
            handlers.append(logging.FileHandler(Path(folder) / f"{name}_{datetime.now():%Y%m%d_%H%M%S}.log", encoding="utf-8"))
        for handler in handlers:
            handler.setFormatter(logging.Formatter(FORMAT))
            logger.addHandler(handler)
    return logger


def get_logger(name: str = "mixlens") -> logging.Logger:
    return logging.getLogger(name)
