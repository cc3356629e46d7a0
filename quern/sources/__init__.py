"""Sources and sinks: files of the kinds the catalogue is made from."""
