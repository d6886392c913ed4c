import sys

from vicinal.service.cli import main

sys.exit(main())
