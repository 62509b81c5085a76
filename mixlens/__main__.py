import sys

from mixlens.cli import main

sys.exit(main())
