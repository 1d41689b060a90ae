import sys

from glyphmill.cli import main

sys.exit(main())
