import sys

from tomeworks.cli import main

sys.exit(main())
