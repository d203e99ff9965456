"""Jobs that go on where their last run ended."""
