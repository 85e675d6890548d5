"""Spark jobs for re-identifying people across large collections of video detections."""
