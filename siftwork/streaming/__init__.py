"""siftwork.streaming"""
