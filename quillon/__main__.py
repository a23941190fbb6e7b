import sys

from quillon.cli import main

sys.exit(main())
