"""Part of gristmill; see the README for the map of modules."""
