"""Token specifications and their compiler: from declared rules to a canonical, hashable artifact."""
