import sys

from commitlens.cli import main

sys.exit(main())
