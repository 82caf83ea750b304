"""Files and other inputs: encodings, compression, scans."""
