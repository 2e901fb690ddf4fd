"""Launcher for spark-submit: ``spark-submit --py-files presswork.zip tools/run.py run ...``."""

import sys

from presswork.__main__ import main

if __name__ == "__main__":
    sys.exit(main())
