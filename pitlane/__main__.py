import sys

from pitlane.cli import main

sys.exit(main())
