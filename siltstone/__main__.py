"""Runs the command line."""
import sys

from siltstone.cli import main

sys.exit(main())
